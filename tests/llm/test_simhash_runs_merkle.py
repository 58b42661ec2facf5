"""SimHash near-dedup, periodic runs and the Merkle manifest against brute force, and on rows at the edge."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emulant.llm import hot, merkle, queries_output, queries_pairs, queries_runs, runs, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        text = " ".join(f"{'W' if rng.random() < 0.2 else 'w'}{rng.randrange(900)}" for _ in range(rng.randrange(1, 160)))
        rows.append((i, text, "en", f"s{rng.randrange(4)}" if i % 3 else "hot", len(text)))
        if i % 6 == 0:  # near copies, in chains
            for j in range(rng.randrange(1, 4)):
                text = text.replace(" w", " w\t", 1) + f" é{j}" * (j % 2)
                rows.append((1000 + 10 * i + j, text, None, "hot", None))
    beat = " ".join(f"b{k}" for k in range(5))
    return rows + [
        (5000, None, "en", None, None),
        (5001, "", "en", None, 0),
        (5002, " \n\t ", "en", "", 4),
        (5003, "One", "en", "", 3),
        (5004, "one TWO", "en", "lone", 7),
        (5005, " ".join([beat] * 9000), "en", "hot", 9),
        (5006, "x " * 40, "en", "hot", 9),
        (5007, f"{beat} {beat} {beat} y y y y y y y y y y y y {beat} {beat}", "en", "hot", 9),
        (5008, rows[7][1], "en", "hot", 9),
        (None, rows[7][1], "en", "hot", 9),
        (None, None, None, None, None),
    ]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- SimHash ------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall(low(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    """Least id reachable for each row of (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


def test_simhash_query_equals_brute_force(spark, rows, folder):
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_classes(fps))), key=str)
    got = sorted(map(tuple, queries_pairs.op11_simhash(spark, folder).collect()), key=str)
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 40


def test_jvm_hash_is_the_same_hash(spark):
    text = "größe of x"
    got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64
    assert got == xxhash.xxh64(text.encode(), seed=42).intdigest()


def test_dense_buckets_are_split_without_loss(spark):
    """One ball of near fingerprints, more than a bucket may hold, and far ones."""
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(250)}
    fps |= {rng.getrandbits(64) for _ in range(150)}
    fps = sorted(fps)
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    links = simhash.block_links(spark.createDataFrame(signed, "fp long"), dense=40).distinct().collect()
    assert all(((u ^ v) % 2**64).bit_count() <= 3 for u, v in links)
    root = {f[0]: f[0] for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[find(u)] = find(v)
    want = brute_classes(list(enumerate(fps)))
    for a in range(len(fps)):
        for b in range(a):
            assert (find(signed[a][0]) == find(signed[b][0])) == (want[a] == want[b])


def test_links_of_a_bucket_are_a_forest():
    rng = random.Random(3)
    fps = np.unique(np.array([7 ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(300)], np.int64))
    u, v = simhash.forest(fps)
    assert len(u) < len(fps)


def test_simhash_passes_other_columns(spark, none):
    docs = spark.createDataFrame([(2, "a b c d", "x", 1), (1, "a b c d", "y", 2), (None, "q", "z", 3)], "doc_id long, text string, simhash string, fp int")
    got = {r["fp"]: r["simhash"] for r in simhash.near_duplicates(docs).collect()}
    assert simhash.near_duplicates(docs).columns == ["doc_id", "text", "fp", "simhash"]
    assert [(got[k]["component_id"], got[k]["kept"]) for k in (1, 2, 3)] == [(1, False), (1, True), (None, True)]
    assert simhash.near_duplicates(none).count() == 0 and simhash.classes(none).count() == 0


def test_spread_join_keeps_hot_and_null_keys(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 3000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 14)], "k long, v long"))
    got = sorted(hot.spread_join(left, right, "k").select("id", "v").collect())
    assert got == sorted(left.join(right, "k", "left").select("id", "v").collect())


# ---- periodic runs ----------------------------------------------------------------


def brute_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, m, q) for (a, m), q in best.items())


def brute_planted(i, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def test_runs_equal_brute_force_on_random_codes():
    rng = random.Random(2)
    for _ in range(1500):
        n, k = rng.randrange(90), rng.choice([1, 2, 2, 3, 5, 10])
        c = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), 1 + rng.randrange(n)
            c = [c[i] if i < a else c[a + (i - a) % min(p, n - a)] for i in range(n)]
            c[rng.randrange(n)] = 99
        codes = np.array(c, np.int64)
        assert runs.runs_of(codes) == brute_runs(c)
        assert sorted((a + s, m, q) for a, z in runs.surviving_segments(codes, 1) for s, m, q in runs.lag_scan(codes[a:z])) == brute_runs(c)


def test_words_that_peel_one_by_one_and_equal_hashes():
    chain = [x for k in range(1, 900) for x in (k + 1, k)]
    assert runs.runs_of(np.array(chain, np.int64)) == brute_runs(chain)
    # Sequences of this kind have equal sums under any factor modulo 2 ** 64.
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    assert runs.runs_of(np.array(morse, np.int64)) == brute_runs(morse)


def test_runs_of_a_long_text_of_one_word():
    assert runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def test_runs_query_equals_brute_force(spark, rows, folder):
    want = []
    for i, text, *_ in rows:
        words = brute_planted(i, text)
        found = brute_runs(words) if i != 5005 else None
        if found is None:  # nine thousand times the same five words
            found = runs.runs_of(runs.codes_of([w.encode() for w in words]))
        gone = {k for a, m, q in found for k in range(a + q, a + m)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want.append(
            (i, len(found), *top, 1000 * top[1] // top[2] if found else None)
            + (sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
        )
    got = sorted(map(tuple, queries_runs.op12_periodic_runs(spark, folder).collect()), key=str)
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 20


def test_runs_at_the_edge(spark, none):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (1, " \t", 3), (None, "a " * 12, 4), (1, "a " * 11, 5)], "doc_id long, text string, runs int")
    got = [r["runs"] for r in runs.find_runs(docs).collect()]
    assert [[tuple(x) for x in r["found"]] for r in got] == [[], [], [], [(0, 12, 1)], []]
    assert [r["collapsed"] for r in got] == ["", "", "", "a", " ".join("a" * 11)]
    assert runs.find_runs(none).count() == 0


# ---- Merkle manifest ----------------------------------------------------------------


def brute_manifest(rows):
    """Rows of the query, the tree folded anew for each row."""

    def leaf(r, text):
        parts = [r[0], r[3], r[2], r[4], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            at = levels[-1]
            levels.append([sha("".join(at[k : k + 16])) for k in range(0, len(at), 16)])
        return levels

    def path(levels, k):
        out = []
        for nodes in levels[:-1]:
            first = k - k % 16
            out.append((nodes[first:k], nodes[k + 1 : first + 16]))
            k //= 16
        return out

    first = lambda x, empty: (x is not None, empty if x is None else x)
    groups = {}
    for r in sorted(rows, key=lambda r: (first(r[3], "".encode()) if r[3] is None else (True, r[3].encode()), first(r[0], 0), leaf(r, r[1]))):
        groups.setdefault(r[3], []).append(r)
    trees = {g: climb([leaf(r, r[1]) for r in members]) for g, members in groups.items()}
    top = climb([t[-1][0] for t in trees.values()])
    out = []
    for g, (name, members) in enumerate(groups.items()):
        for k, r in enumerate(members):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = low(text)
            folded, siblings = leaf(r, text), ""
            for before, after in path(trees[name], k) + path(top, g):
                folded = sha("".join([*before, folded, *after]))
                siblings += "".join(before + after)
            root = top[-1][0]
            out.append((r[0], leaf(r, r[1]), trees[name][-1][0], root, sha(siblings), folded, folded == root))
    return sorted(out, key=str)


def test_manifest_query_equals_brute_force(spark, rows, folder):
    got = sorted(map(tuple, queries_output.op13_merkle_manifest(spark, folder).collect()), key=str)
    want = brute_manifest(rows)
    assert got == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_manifest_of_many_blocks_and_groups(spark, tmp_path):
    """A group of more than one block, more groups than one parent holds, repeated ids and rows."""
    rows = [(k // 2, f"T{k // 3}", "en", "big", k) for k in range(4400)] + [(k, f"T{k}", None, f"g{k}", None) for k in range(300)]
    rows += [(7, "same", "en", "twins", 1)] * 20
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries_output.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark, none):
    one = spark.createDataFrame([(1, "a", None, None, None)], SCHEMA)
    r = merkle.manifest(one, merkle.leaf_digest(F.col("text"))).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == sha("1:a") and r["verified"]
    assert r["proof_sha256"] == sha("")
    assert merkle.manifest(none, merkle.leaf_digest(F.col("text"))).count() == 0


def test_fold_resumes_the_retained_state():
    leaves = [sha(str(k)) for k in range(300)]
    tree = merkle._Tree(leaves, 300, ["", sha("right")])
    for slot in (0, 15, 16, 150, 299):
        changed = list(leaves)
        changed[slot] = sha("new")
        assert tree.fold(slot, sha("new")) == sha(merkle._Tree(changed, 300, []).levels[-1][0] + sha("right"))
