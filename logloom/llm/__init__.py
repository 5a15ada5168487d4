"""Operations of a training-data pipeline on Spark: deduplication, filters,
language and quality models, chat formatting, web archives and mixing.

Nothing else in the library imports this subpackage.
"""
