"""Exact, near and substring dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumaframe.llm import registry
from lumaframe.llm import substring_dedup as S
from lumaframe.llm.common import connected_components
from lumaframe.llm.exact_dedup import drop_copies, exact_dedup
from lumaframe.llm.simhash import MAX_BITS, drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates, prune

SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_exact_brute_force(sets):
    for df in sets:
        groups = defaultdict(list)
        for i, t in rows_of(df):
            groups[(t or "").translate(SPACE)].append((-len(t or ""), i is None, i or 0, i))
        want = Counter()
        for norm, rows in groups.items():
            rows.sort()
            for k, row in enumerate(rows):
                want[row[3], rows[0][3], len(rows), k == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(df).collect())
        assert got == want


def test_exact_keeps_columns_and_one_of_each(edges, nothing):
    out = drop_copies(edges)
    assert out.columns == edges.columns
    texts = [(t or "").translate(SPACE) for _, t in rows_of(out)]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(SPACE) for _, t in rows_of(edges)})
    assert drop_copies(nothing).count() == 0 and exact_dedup(nothing).count() == 0


def test_exact_digits(spark):
    """Texts that differ only at, before or after the ends of digits."""
    base = "".join(random.Random(5).choice("abcdef") for _ in range(200_000))
    lengths = [31, 32, 33, 543, 544, 545, 8736, 139_808, 139_809, 200_000]
    rows = [(k * 2 + c, base[:n]) for k, n in enumerate(lengths) for c in (0, 1)] + [(100 + k, base[: n - 1] + "X") for k, n in enumerate(lengths)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k * 2 + c] == (k * 2, 2) for k in range(len(lengths)) for c in (0, 1))
    assert all(got[100 + k] == (100 + k, 1) for k in range(len(lengths)))


def test_exact_sql(agrees):
    agrees(registry.op8_exact_dedup, registry.oracle_sql()["op8_exact_dedup"])


def components(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= MAX_BITS):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(f))]


@pytest.mark.parametrize("hot", [4096, 1])
def test_near_brute_force(sets, hot):
    for df in sets:
        rows = rows_of(df)
        fps = [fingerprint(None if t is None else t.encode()) for _, t in rows]
        roots = components(fps)
        least = {}
        for (i, _), r in zip(rows, roots):
            if i is not None:
                least[r] = min(least.get(r, i), i)
        want = Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots))
        got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(df, hot).collect())
        assert got == want


def test_fingerprint_by_hand():
    import xxhash

    words = [b"one", b"two", b"three", b"four", b"five", b"four"]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(3)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > 3)
    assert fingerprint("One two\tTHREE four\n five FOUR".encode()) == want
    assert fingerprint(b"a B") == xxhash.xxh64_intdigest(b"a b", 42)
    assert fingerprint(None) == fingerprint(b" \n") == 0


def test_hash_is_the_engines(spark):
    from pyspark.sql import functions as F
    import xxhash

    got = spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)


def test_pigeonring_misses_nothing(spark):
    """Every pair within four bits holds the chains from some segment, and is linked."""
    rng = random.Random(1)
    for _ in range(3000):
        flips = rng.sample(range(64), rng.randint(0, 4))
        fp = np.array([0, sum(1 << b for b in flips)], dtype=np.uint64)
        assert any(len(prune(np.array([0]), np.array([1]), np.array([i]), fp)[0]) for i in range(5))
    for _ in range(3000):  # and no pair beyond them does
        fp = np.array([0, sum(1 << b for b in rng.sample(range(64), rng.randint(5, 9)))], dtype=np.uint64)
        assert not any(len(prune(np.array([0]), np.array([1]), np.array([i]), fp)[0]) for i in range(5))
    base = rng.getrandbits(63)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = [x - (1 << 64) if x >> 63 else x for p in pairs for x in p]
    df = spark.createDataFrame([(x,) for x in set(signed)], "fp long").repartition(4)
    roots = {r["node"]: r["root"] for r in connected_components(fingerprint_links(df)).collect()}
    for a, b in zip(signed[::2], signed[1::2]):
        assert roots[a] == roots[b]
    assert base


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_near_keeps_one_of_each(edges, nothing):
    near = near_duplicates(edges).collect()
    classes = {r["root"] for r in near}  # two components may have one smallest id, where ids repeat
    out = drop_near_duplicates(edges)
    assert out.columns == edges.columns and out.count() == len(classes)
    assert drop_near_duplicates(nothing).count() == 0


def removed(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings_brute_force(spark, sets, hot):
    rng = random.Random(2)
    bases = ["ab" * 300, "x" * 900, "".join(rng.choice("abc ") for _ in range(900)), "é" * 150, "".join(rng.choice("abcdefgh") for _ in range(700))]

    def part():
        b = rng.choice(bases)
        return b[rng.randint(0, 60) : rng.randint(150, 700)]

    made = [(i, part() + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 120))) + part()) for i in range(50)]
    for df in (*sets, spark.createDataFrame(made, "doc_id long, text string").repartition(4)):
        rows = rows_of(df)
        want = Counter((i, *r) for (i, _), r in zip(rows, removed([t for _, t in rows])))
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df, hot).collect())
        assert got == want


def test_hashes_of_strings():
    """Against the polynomials themselves, and on strings that double themselves."""
    rng = random.Random(9)
    text = bytes(rng.choice(b"abc") for _ in range(400))
    data = np.frombuffer(text, np.uint8)

    def by_hand(part, bases):
        one, two = (sum(int(S._BYTES[c]) * pow(b, k, S.PRIME) for k, c in enumerate(part)) % S.PRIME for b in bases)
        return int(S._mix(np.array([one << 32 | two], dtype=np.uint64))[0])

    for bases in (S.GRAM_BASES, S.STRETCH_BASES):
        roll = S.Roll(data, bases)
        assert all(int(h) == by_hand(text[i : i + 64], bases) for i, h in enumerate(roll.all(64)))
        assert int(roll(np.array([7]), np.array([390]))[0]) == by_hand(text[7:390], bases)
    a, b = b"a", b"b"
    while len(a) < 256:
        a, b = a + b, b + a
    for bases in (S.GRAM_BASES, S.STRETCH_BASES):
        x, y = (int(S.Roll(np.frombuffer(t, np.uint8), bases).all(256)[0]) for t in (a, b))
        assert x != y and bin(x ^ y).count("1") > 8


def test_anchors_own_every_string_once():
    text = bytes(random.Random(4).choice(b"ab") for _ in range(5000))
    own, gram, stretch, lo, n, at = S.anchors([b"q" * 150, text, b"", text[:300]])
    assert sorted(x for k, l, m in zip(own, lo, n) if k == 1 for x in range(l, l + m)) == list(range(5000 - 199))
    assert all(0 <= a - (m - 1) and a + S.GRAM <= S.MIN_LENGTH + 0 or a >= m - 1 for a, m in zip(at, n))
    one = {(l, m): (g, s) for k, g, s, l, m in zip(own, gram, stretch, lo, n) if k == 3}
    assert one and all(0 <= l < 101 for l, _ in one)


def test_texts_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 700)
    text = bytes(random.Random(6).choice(b"abc") for _ in range(5000))
    starts = []
    for index, begin, lot in S._chunks([text, b"z" * 199]):
        own, _, _, lo, n, _ = S.anchors(lot)
        starts += [begin[k] + x for k, l, m in zip(own, lo, n) for x in range(l, l + m)]
    assert sorted(starts) == list(range(5000 - 199))


def test_substrings_of_nothing(nothing):
    assert S.remove_repeats(nothing).count() == 0


def test_near_copies_without_ids_are_one(spark):
    """A component of several fingerprints none of whose rows has an id."""
    words = [f"w{i}" for i in range(500)]
    own = fingerprint(" ".join(words).encode())
    others = (" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(500))
    near = [t for t in others if 1 <= (fingerprint(t.encode()) ^ own).bit_count() <= MAX_BITS][:3]
    docs = spark.createDataFrame([(None, t) for t in (" ".join(words), *near)], "doc_id long, text string")
    assert len(near) == 3 and drop_near_duplicates(docs).count() == 1
