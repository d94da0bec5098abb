"""The operators that use DataFrame functions only: digests and line dedup, against plain Python."""

import hashlib
import random
import re
import unicodedata

import pytest
import xxhash

from parchment.llm import op02_digest as op2
from parchment.llm import op10_lines as op10

R = random.Random(4)


def canon(t):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", n(n(t).casefold())).strip(" ")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def fingerprint(t):
    out = ""
    for i in (1, 2):
        h = xxhash.xxh64(i.to_bytes(4, "little"), seed=42).intdigest()
        out += f"{xxhash.xxh64(canon(t).encode(), seed=h).intdigest():016x}"
    return out


DOCS = [
    (5, "Ｆull  Width\tText"), (9, "full width text"), (700, None), (701, ""), (70000, "Straße ﬁne"), (70001, "STRASSE FINE "), (-4, "é"), (3_000_000, "É"), (5_000_000_000, "Ω 😀 ab"), (None, "null id"), (9, "again 9"),
    *[(100 + i, "".join(R.choice("ab \nÄé😀") for _ in range(R.randint(0, 40)))) for i in range(200)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, k int, digest string").repartition(3)


def test_fingerprints(docs):
    order = sorted(((-(2**63) if i is None else i, signed(xxhash.xxh64((t or "").encode(), seed=42).intdigest()), t or "") for i, t in DOCS))
    want = []
    for n, (i, _, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][2]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        want.append((None if i == -(2**63) else i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e), float(fingerprint(t) == fingerprint(e)), float(fingerprint(t) == fingerprint(nxt))))
    got = [tuple(r)[:7] for r in op2.fingerprints(docs).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_collisions(docs):
    """With digests of 3 bits nearly all collide, and bytes tell the texts apart."""
    once, apart = op2.classes(docs, bits=3)
    got = {(r.k, r.t): r.class_id for r in apart.collect()}
    rows = [(-(2**63) if i is None else i, signed(xxhash.xxh64((t or "").encode(), seed=42).intdigest()), canon(t or "")) for i, t in DOCS]
    least = {}
    for k, _, c in rows:
        least[c] = min(k, least.get(c, k))
    assert len(got) > 150 and all(got[k, t] == least[c] for k, t, c in rows if (k, t) in got)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op2.fingerprints(none).count() == 0 and op10.cleaned(none).count() == 0


def edit(s):
    i = R.randrange(len(s))
    return R.choice([s[:i] + s[i + 1 :], s[:i] + R.choice("xyzé😀") + s[i:], s[:i] + R.choice("xyzé😀") + s[i + 1 :]])


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    return p + q >= max(len(a), len(b)) - 1


def line_docs():
    pool = ["".join(R.choice("abcd é") for _ in range(R.randint(1, 40))) for _ in range(60)] + ["aaaaaaaaaaaaaaaaaaaa", "abababababababababab", "short", "", "  "]
    out = [(3, None), (4, ""), (5, "\n\n"), (6, "one line of some length\r\n one line of some length")]
    for i in range(10, 90):
        lines = [R.choice(pool) for _ in range(R.randint(1, 6))]
        for j, x in enumerate(lines):
            for _ in range(R.choice([0, 0, 1, 1, 2])):
                lines[j] = x = edit(x) if x else x
        out.append((i, "\n".join(lines)))
    return out


def test_lines(spark):
    docs = line_docs()
    earlier, want = [], {}
    for i, t in sorted(docs):
        kept = []
        for x in (t or "").split("\n"):
            if not re.sub(r"[ \t\r\f\v]", "", x):
                kept.append(x)
                continue
            if not any(x == y or min(len(x), len(y)) >= 16 and within_one(x, y) for y in earlier):
                kept.append(x)
            earlier.append(x)
        want[i] = None if t is None else "\n".join(kept)
    df = spark.createDataFrame([(i, t, "c", 2) for i, t in docs], "doc_id long, text string, line string, n int").repartition(3)
    got = {r.row.doc_id: r.clean for r in op10.cleaned(df).withColumn("clean", op10._text()).collect()}
    assert got == want
