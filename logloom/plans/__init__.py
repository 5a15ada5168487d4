"""Registered query plans (one per operator of the inventory), their DuckDB
oracle SQL, and the parameters both share."""
