"""Personal data: base patterns, the network, whole results."""

import hashlib
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import pii
from tests.llm.samples import SF, clashing, docs, empty, odd  # noqa: F401

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2:
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
                if not 16 <= len(d) <= 19 or total % 10:
                    continue
            if k == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


TRICKY = [
    "a@b.c@d.e f@g.h", "@x.y a@b a@b. a@b.c. .@a.b-c", "é@x.yz josé.m@mail.example.com", "1.2.3.4.5.6.7.8.9", "1.2.3 1.2.3.256 0001.2.3.4",
    "300.1.2.3.4", "4556737586899855 4556 7375 8689 9855, 4556-7375-8689-9855", "4556737586899855 4556737586899855", "45567375868998551",
    "+1 (377) 555-0271 +1(377)555-0271. +123 +1--2 ++12345678", "+1 (377) 555-0271 190.137.223.204", "9" * 3000 + ".1.2.3",
    "+" * 50 + "1 2 3 4 5 6 7 8", "a" * 5000 + "@" + "b." * 300 + "c", "1-2 3- 4 -5  6", "٣٤٥٦ ４５５６７３７５８６８９９８５５", "a@b.c" * 40,
    "x@y.z\n+49 30 901820-0\r\n10.0.0.1\t", "1..2.3.4.5", "%+-._@-.-",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(3)
    for alphabet in ("a@.b ", "0125. ", "45 -+", "+1() .-9", "a@.1+- é"):
        for _ in range(300):
            text = "".join(rng.choice(list(alphabet), rng.integers(0, 60)))
            assert pii.base_spans(text) == plain_base(text)


def small_net():
    net = pii.Tagger.fresh(3, 4)
    rng = np.random.default_rng(1)
    net.a = rng.normal(0, 1, net.a.shape)
    net.s = rng.normal(0, 1, net.s.shape)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    return net


def plain_emissions(net, classes):
    """One window, one step at a time."""
    h = net.r.shape[1]
    sides = []
    for d, order in enumerate((classes, classes[::-1])):
        hid, cell, out = np.zeros(h), np.zeros(h), []
        for c in order:
            z = net.w[d, c] + hid @ net.r[d]
            i, f, o = (1 / (1 + np.exp(-z[k * h:(k + 1) * h])) for k in range(3))
            cell = f * cell + i * np.tanh(z[3 * h:])
            hid = o * np.tanh(cell)
            out.append(hid)
        sides.append(out if d == 0 else out[::-1])
    return np.array([np.concatenate(p) @ net.u + net.b for p in zip(*sides)])


def path_score(net, e, tags):
    a, s = net.steps()
    return s[tags[0]] + e[0, tags[0]] + sum(a[p, q] + e[t + 1, q] for t, (p, q) in enumerate(zip(tags, tags[1:])))


def test_states_viterbi_and_likelihood_by_brute_force():
    net = small_net()
    x = np.random.default_rng(2).integers(0, pii.CLASSES, (4, 3))
    y = np.array([[0, 1, 2], [1, 2, 2], [2, 2, 0], [0, 3, 5]])
    best, loss = net.decode(x), 0
    for b in range(3):
        e = plain_emissions(net, x[:, b])
        assert np.allclose(e, net.emissions(x)[:, b], atol=1e-5)
        paths = {p: path_score(net, e, p) for p in product(range(pii.TAGS), repeat=4)}
        assert tuple(best[:, b]) == max(paths, key=paths.get)
        scores = np.array(list(paths.values()))
        loss += np.log(np.exp(scores - scores.max()).sum()) + scores.max() - path_score(net, e, y[:, b])
    assert abs(net.loss(x, y)[0] - loss / 3) < 1e-4


def test_gradients():
    net = small_net()
    rng = np.random.default_rng(5)
    x = rng.integers(0, pii.CLASSES, (6, 4))
    y = np.array([[0] * 4, [1, 0, 3, 0], [2, 0, 4, 5], [2, 7, 4, 6], [0, 8, 0, 6], [0, 8, 1, 0]])
    grads = net.loss(x, y)[1]
    for n in net.NAMES:
        v = getattr(net, n)
        spots = [(0, int(x[0, 0]), 1)] if n == "w" else []
        for at in spots + [tuple(rng.integers(k) for k in v.shape) for _ in range(6)]:
            if n == "a" and not pii.ALLOWED[at]:
                continue
            keep, ends = v[at], []
            for step in (1e-4, -1e-4):
                v[at] = keep + step
                ends.append(net.loss(x, y)[0])
            v[at] = keep
            assert abs((ends[0] - ends[1]) / 2e-4 - grads[n][at]) < 1e-3, (n, at)


def plain_stretches(text):
    """Ranges of characters that the network reads."""
    cover = set()
    digits = [i for i, c in enumerate(text) if c in "0123456789"]
    group = []
    for i in digits + [10 ** 9]:
        if group and i - group[-1] > 4:
            if len(group) >= 4:
                cover |= set(range(max(0, group[0] - pii.CONTEXT), min(len(text), group[-1] + 1 + pii.CONTEXT)))
            group = []
        group.append(i)
    for i, c in enumerate(text):
        if c == "@":
            a, b = i, i + 1
            while a and ord(text[a - 1]) > 32:
                a -= 1
            while b < len(text) and ord(text[b]) > 32:
                b += 1
            cover |= set(range(max(0, a - pii.CONTEXT), min(len(text), b + pii.CONTEXT)))
    out = []
    for i in sorted(cover):
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return out


def plain_spans(net, text):
    """All spans, one window and one character at a time."""
    base = plain_base(text)
    e64 = pii.Tagger(*[getattr(net, n).astype(np.float64) for n in net.NAMES])
    a, s = e64.steps()
    added = []
    for low, high in plain_stretches(text):
        starts = [low]
        while starts[-1] + pii.WINDOW < high:
            starts.append(starts[-1] + pii.STRIDE)
        tag, depth = {}, {}
        for j, w in enumerate(starts):
            x = [int(pii.classes_of(np.array([ord(c)]))[0]) for c in text[w:min(high, w + pii.WINDOW)]]
            x += [0] * (pii.WINDOW - len(x))
            e = plain_emissions(e64, np.array(x))
            score, back = e[0] + s, []
            for t in range(1, len(x)):
                way = score[:, None] + a
                back.append(way.argmax(axis=0))
                score = way.max(axis=0) + e[t]
            tags = [int(score.argmax())]
            for bk in reversed(back):
                tags.append(int(bk[tags[-1]]))
            tags.reverse()
            for i in range(w, min(high, w + pii.WINDOW)):
                left = i - w + 0.5 if j else 10 ** 6  # distance from the edges inside the stretch
                right = w + pii.WINDOW - i - 0.5 if j + 1 < len(starts) else 10 ** 6
                if min(left, right) > depth.get(i, -1):
                    depth[i], tag[i] = min(left, right), tags[i - w]
        i = low
        while i < high:
            k = (tag[i] + 1) // 2
            j = i + 1
            while j < high and (tag[j] + 1) // 2 == k and tag[j] % 2 == 0:
                j += 1
            if k:
                added.append((k - 1, i, j))
            i = j
    out = []
    for k, p, q in added:
        p, q = pii._trimmed(k, text, p, q)
        if p >= q or not pii._SHAPES[k].fullmatch(text, p, q) or not pii.accepts(k, text[p:q]):
            continue
        if k and re.match("[0-9]", text[p - 1:p] or "x") or k and re.match("[0-9]", text[q:q + 1] or "x"):
            continue
        if not any(x < q and p < y for _, x, y in base):
            out.append((k, p, q))
    return base, sorted(base + out)


@pytest.fixture(scope="module")
def net(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), steps=160)


def rows_of(df, net):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added, r.base, r.spans)
                   for r in pii.find(df, net).collect()))


def plain_rows(df, net):
    out = []
    for r in df.collect():
        base, spans = plain_spans(net, r.text or "")
        out.append((r.doc_id is None, r.doc_id or 0, *[sum(k == kind for k, _, _ in base) for kind in range(4)],
                    len(spans) - len(base), pii.as_text(base), pii.as_text(spans)))
    return sorted(out)


RUN_TOGETHER = ["Call +1 (843) 555-7672 170.106.47.218 now", "x 7536784127813050 4845168114407329 y",
                "on 2353820953013749 4550997810720808 in", "see +1 (826) 555-4081 190.137.223.204."]


def test_whole_table_equals_plain_version(spark, docs, net):
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(RUN_TOGETHER + TRICKY)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    assert rows_of(both, net) == plain_rows(both, net)


def test_network_adds_what_runs_together(spark, net):
    rows = spark.createDataFrame(list(enumerate(RUN_TOGETHER)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in pii.find(rows, net).collect()}
    assert sum(r.n_added for r in found.values()) >= 4
    for i, text in enumerate(RUN_TOGETHER):
        for span in filter(None, found[i].spans.split(",")):
            kind, a, b = span.split(":")
            assert pii.accepts(pii.KINDS.index(kind), text[int(a):int(b)])


def test_numbers_that_are_no_data_are_left(spark, net):
    texts = ["In 2024-01-15 10:30:00 it cost 1,234.50", "order 1234567890123 of 12", "id 04dbebab91ab85687d33eeaaf9ac699e1188f962",
             "v1.2.3 and 3.14159", "1234567812345678 is no card", "7" * 40, "page 12 13 14 15 16 17"]
    out = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), net)
    assert out.where("n_added > 0").count() == 0


def test_odd_rows_and_no_labels(spark, odd, clashing, empty, net):
    assert rows_of(odd, net) == plain_rows(odd, net)
    assert rows_of(clashing, net) == plain_rows(odd, net)
    assert rows_of(empty, net) == []
    assert pii.train(odd) is None and pii.train(empty) is None
    assert rows_of(odd, None) == plain_rows(odd, net)


def test_very_long_hostile_texts(net):
    texts = ["1" * 300_000, "@" * 100_000, "a@" * 100_000, "+1 " * 100_000, "1.1.1.1." * 50_000, "4556737586899855 " * 20_000, "x" * 10 ** 6]
    _, base, spans = pii._found(net, pa.array(texts))
    for b, s in zip(base, spans):
        assert set(b) <= set(s) and len(set(s)) == len(s)


def test_redacted_texts(spark, net):
    rows = spark.createDataFrame([(1, "mail a.b@c.de or +1 (377) 555-0271!", 7), (2, None, 8)], "doc_id bigint, text string, spans int")
    out = {r.doc_id: r for r in pii.redact(rows, net).collect()}
    assert out[1].text == "mail <EMAIL> or <PHONE>!" and out[1].spans == 7 and out[2].text is None


def test_query_digests(spark):
    from logloom.llm.queries import op12_personal_data

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op12_personal_data(spark, SF).collect():
        base = plain_base(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.as_text(base).encode()).hexdigest()
        assert set(pii.as_text(base).split(",")) <= set(r.spans.split(","))
