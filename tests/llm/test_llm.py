"""Operators for training corpora against brute force, and their defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from reachgrid.llm import decontaminate, fixity, html_text, licences, line_dedup, ngram_join, packing, quality, queries, sharding, texts, token_store, words
from reachgrid.llm.components import components

FOLDER = f"{compare.DATA}/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BITS = 16
LONG = "lorem ipsum dolor sit amet " * 40_000

EDGES = [
    (1, "a b c d e f g h i j k l m n o p\nshared line of some words here", "en", "s"),
    (1, "a b c d e f g h i j k l m n o p\nshared line of some words here", "en", "s"),  # repeated row
    (2, "A b c d e f g h i j k l m n o p\nshared line of some words here", None, None),
    (None, "a b c d e f g h i j k l m n o p\nshared line of some words here", "xx", "s"),
    (None, None, None, None),
    (None, None, None, None),
    (3, None, "en", "s"),
    (4, "", "en", "s"),
    (5, " \n\t\n", "de", ""),
    (6, "one two", "en", "s"),
    (7, "One two", "en", "s"),
    (8, LONG, "en", "s"),
    (9, LONG + "x", "en", "s"),
    (10, "\U0001f600 é́ ß \x85 \xa0 <|endoftext|> don't\r\n", "fr", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that an operator might use itself.
CLASH = ["k1", "_k1", "_own_k1", "n", "rid", "cls", "key", "_lines", "_gone_k1", "_gone", "items", "_scan", "_quality_counts", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet")


def key(row):
    return tuple((v is None, str(v)) for v in row)


# Words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 .,'\n\t\x0b\x1c\xa0é\U0001f600-", max_size=30)), max_size=12), st.integers(1, 5))
def test_words_and_grams(values, k):
    for separator, pattern in ((words.WHITE, WHITE), (words.NOT_ALNUM, ALNUM)):
        column = pa.array(values, pa.string())
        seen, want = [], []
        for i, j, w in words.read_words(column, separator):
            raw = words.LOWER[w.raw]
            found = [raw[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
            grams, bounds = words.text_grams(w, k)
            for r in range(j - i):
                own = found[w.first[r] : w.first[r + 1]]
                seen.append(own)
                g = grams[bounds[r] : bounds[r + 1]]
                runs = [tuple(own[x : x + k]) for x in range(max(1, len(own) - k + 1))] if own else []
                want.append((runs, g.tolist()))
        assert seen == [pattern.findall((v or "").translate(UP)) for v in values]
        forward, back = {}, {}
        for runs, hashes in want:
            assert len(runs) == len(hashes)
            for a, b in zip(runs, hashes):
                assert forward.setdefault(a, b) == b and back.setdefault(b, a) == a


def test_slices_cover_all_rows_once():
    bounds = np.array([0, 5, 5, 200, 201, 260])
    got = [r for i, j in words.slices(bounds, 50) for r in range(i, j)]
    assert got == list(range(5))


# Components


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# 1: WARC


def test_audit_finds_each_kind_of_damage(spark, tmp_path):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    places = fixity.layout(pages, file_bytes=20_000)
    records = fixity.records(pages, places, ("page_id",))
    text = records.withColumn("value", F.when(F.col("page_id") == 7, F.concat(F.expr("left(value, length(value) - 1)"), F.lit("?"))).otherwise(F.col("value")))
    last = places.agg(F.max("file")).first()[0]
    fixity.write_archive(text.where(F.col("file") != last), str(tmp_path / "warc"))
    one = fixity.tree_of_records(records, fanout=2)
    other = fixity.tree_of_archive(spark, str(tmp_path / "warc"), places, fanout=2)
    bad, compared = fixity.audit(one, other, fanout=2)
    where = {(r.file, r.record): r.page_id for r in places.collect()}
    lost = {p for (f, _), p in where.items() if f == last}
    assert {where[r.file, r.record] for r in bad.collect()} == lost | {7}
    assert sum(compared) < one.count()
    # Offsets and digests by hand.
    at, file = {}, None
    for r in sorted(places.collect(), key=lambda r: (r.file, r.record)):
        if r.file != file:
            file, expected = r.file, 0
        assert r.offset == expected
        expected += r.length
        at[r.page_id] = r
    leaves = {(r.file, r.number): r.hash for r in one.where("level = 0").collect()}
    for p in pages.collect():
        body = p.html.encode()
        whole = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{p.page_id}>\r\nWARC-Target-URI: {p.url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        r = at[p.page_id]
        assert r.length == len(whole) and leaves[r.file, r.record] == hashlib.sha256(whole).hexdigest()
    # The stored files are plain WARC at those offsets.
    stored = {r.file: r.value for r in spark.read.schema("value string, file long").text(str(tmp_path / "warc"), wholetext=True).collect()}
    r = at[0]
    assert stored[r.file].encode()[r.offset : r.offset + r.length].startswith(b"WARC/1.1\r\n")


def test_audit_of_odd_pages(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, None, None), (2, None, ""), (None, "v", "y" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("k1", "file", "record", "value")})
    places = fixity.layout(pages, file_bytes=100)
    assert places.count() == 4  # repeated rows are one record
    records = fixity.records(pages, places)
    fixity.write_archive(records, str(tmp_path / "warc"))
    one, other = fixity.tree_of_records(records), fixity.tree_of_archive(spark, str(tmp_path / "warc"), places)
    bad, _ = fixity.audit(one, other)
    assert bad.count() == 0 and fixity.verdicts(places, one, bad).where("intact").count() == 4
    none = fixity.layout(pages.limit(0))
    tree = fixity.tree_of_records(fixity.records(pages.limit(0), none))
    assert fixity.verdicts(none, tree, fixity.audit(tree, tree)[0]).count() == 0


# 2: n-gram join


def shingles(text, k):
    w = WHITE.findall((text or "").translate(UP))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def linked(rows, k, num, den):
    """Component of each row number by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(rows))]


def expected_components(rows, k, num, den):
    sets, part = linked(rows, k, num, den)
    least = defaultdict(list)
    for (d, _), p in zip(rows, part):
        if d is not None:
            least[p].append(d)
    return sorted(((d, len(s), min(least[p], default=None)) for (d, _), s, p in zip(rows, sets, part)), key=key)


def test_near_copies_by_brute_force(spark, rows):
    rng = random.Random(3)
    base = max((t for _, t in rows if len(t) < 3000), key=len).split(" ")
    extra = []
    for i in range(60):  # chains of edits: not all pairs of the group link
        if rng.random() < 0.3:
            base = base[:]
        copy = base[:]
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
        if rng.random() < 0.2:
            base = copy
        extra.append((10_000 + i, " ".join(copy)))
    both = rows + extra
    got = ngram_join.link(spark.createDataFrame(both, "doc_id long, text string"), rarity_bits=BITS)
    got = sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key)
    assert got == expected_components(both, 4, 85, 100)


def test_links_of_odd_rows(edges, empty):
    got = ngram_join.link(edges, rarity_bits=BITS).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=key) == expected_components([r[:2] for r in EDGES], 4, 85, 100)
    assert ngram_join.link(empty, rarity_bits=BITS).collect() == []
    kept = ngram_join.one_of_each(edges)
    assert kept.columns == edges.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 2, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 10: 1})
    assert ngram_join.one_of_each(empty).collect() == []


def test_chains_inside_a_group(spark):
    """Members that match each other but not the first one; their edge shingles are frequent elsewhere, so the group has one prefix."""
    rng = random.Random(12)
    rows = []
    for _ in range(10):
        base = [f"w{rng.randrange(10_000)}" for _ in range(23)]
        first, last = f"f{rng.randrange(10_000)}", f"l{rng.randrange(10_000)}"
        made = [[first] + base[1:], base, base[:-1] + [last], base[:-1] + [last + "x"], [first + "y"] + base[1:]]
        rng.shuffle(made)
        rows += [(len(rows) + i, " ".join(m)) for i, m in enumerate(made)]
        # Fillers make the shingles at both ends frequent.
        for edge in {tuple(m[:7]) for m in made} | {tuple(m[-7:]) for m in made}:
            rows += [(len(rows) + i, " ".join([f"q{rng.randrange(100_000)}" for _ in range(60)] + list(edge))) for i in range(3)]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), k=4, num=80, den=100, rarity_bits=BITS)
    got = sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key)
    assert got == expected_components(rows, 4, 80, 100)


# 3: token store


def test_tokens_round_trip(spark, docs, edges, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    reference = Tokenizer.from_file(path)
    odd = ["It's <|startoftext|>A<|endoftext|>b <|EndOfText|>", "a'S b'll.'s c-'t 'd9's x́ İ İ ΑΣ Σ", "x…,y ,…z a\x00b   q　r 1234 5.6e7", "é,à!ö̈ ﬁ ½ ①"]
    some = edges.select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(60)).unionByName(
        spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    )
    out = str(tmp_path / "tokens")
    token_store.write_tokens(some, out, path)
    got = token_store.read_tokens(spark, out).withColumn("crc", token_store.ids_crc32(F.col("ids"))).collect()
    want = Counter()
    for r in some.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[r.doc_id, tuple(ids)] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.crc == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0))
    assert [tuple(r) for r in token_store.ids_of(spark, out, [100_002]).collect()] == [(100_002, reference.encode(odd[2], add_special_tokens=False).ids + [1])]
    token_store.write_tokens(empty, str(tmp_path / "none"), path)
    assert token_store.read_tokens(spark, str(tmp_path / "none")).collect() == []


def test_files_prune_by_statistics_and_bloom_filters(spark, tmp_path):
    import public_tokenizers

    out = str(tmp_path / "tokens")
    rows = spark.range(0, 20_000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id")).alias("text"))
    token_store.write_tokens(rows.repartition(3), out, public_tokenizers.path(queries.TOKENIZER))

    def read(df):
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan().collectLeaves()
        return len(found), sum(plan.apply(i).metrics().apply("numOutputRows").value() for i in range(plan.size()))

    whole = spark.read.schema(token_store.SCHEMA).orc(out)
    assert read(whole) == (20_000, 20_000)
    # One row group holds it.
    found, seen = read(token_store.ids_of(spark, out, [20_000]))
    assert found == 1 and seen <= 1000
    # Inside the bounds of some row group, but in no Bloom filter.
    missing = [read(token_store.ids_of(spark, out, [d])) for d in (10_001, 20_001, 30_001)]
    assert sum(seen for _, seen in missing) <= 1000 and all(found == 0 for found, _ in missing)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", queries.TOKENIZER])
def test_other_tokenizers_take_whole_texts(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    assert token_store.by_pieces(path) == (name == queries.TOKENIZER)
    texts_ = ["Hello  World, don't\n\nstop", "", "x" * 300, "Zażółć gęślą İstanbul", "a-b c_d 12.5 <|endoftext|> x"]
    raw, bounds = words.bytes_of(pa.array(texts_))
    encoder = token_store.encoder_of(path)
    reference = Tokenizer.from_file(path)
    for _ in range(2):
        ids, ends = encoder(raw, bounds)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [reference.encode(t, add_special_tokens=False).ids for t in texts_]


# 4: line dedup


def without_repeats(rows, num, den, least=1):
    seen, out = [], {}
    for d, t in rows:
        gone, lines = set(), t.split("\n")
        for k, line in enumerate(lines):
            s = shingles(line, 5)
            if s and len(s) >= least:
                if any(den * len(s & o) >= num * len(s | o) for o in seen if den * min(len(s), len(o)) >= num * max(len(s), len(o))):
                    gone.add(k)
                seen.append(s)
        out[d] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("least", [1, 5])
def test_lines_by_brute_force(spark, rows, least):
    rng = random.Random(4)
    lines = [x for _, t in rows[:40] for x in t.split("\n") if len(x.split()) > 8]
    extra = []
    for i in range(40):
        made = []
        for x in rng.sample(lines, 4):
            w = x.split(" ")
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
            made.append(" ".join(w))
        extra.append((5000 + i, "\n".join(made)))
    both = rows[:120] + extra
    got = line_dedup.dedup_lines(spark.createDataFrame(both, "doc_id long, text string"), least=least, rarity_bits=BITS)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got.collect()} == without_repeats(both, 80, 100, least)


def test_lines_of_odd_rows(edges, empty):
    got = line_dedup.dedup_lines(edges, rarity_bits=BITS)
    assert got.columns == [*edges.columns, "n_lines", "n_removed"]
    found = Counter((r.doc_id, r.n_lines, r.n_removed) for r in got.collect())
    # Ids 1 and 1 are one document. LONG has five tokens, and LONG + "x" one more.
    assert found == Counter({(1, 2, 0): 2, (2, 2, 2): 1, (None, 2, 2): 1, (None, 0, 0): 2, (3, 0, 0): 1, (4, 1, 0): 1, (5, 3, 0): 1, (6, 1, 0): 1, (7, 1, 1): 1, (8, 1, 0): 1, (9, 1, 1): 1, (10, 2, 0): 1})
    assert line_dedup.dedup_lines(empty, rarity_bits=BITS).collect() == []


# 5: quality rules


def measures(t):
    w, lines, seen, dup = WHITE.findall(t), t.split("\n"), set(), 0
    for x in lines:
        if WHITE.search(x):
            dup += x in seen
            seen.add(x)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, inside = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            inside |= set(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside))


def test_measures_by_brute_force(docs, edges, empty):
    table = quality.judge(quality.measured(docs.select("doc_id", "text", "lang").unionByName(edges.select("doc_id", "text", "lang"))), {})
    for r in table.collect():
        want = measures(r.text or "")
        assert tuple(r[quality.Q])[:5] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    labels = edges.select("doc_id", F.lit(1).alias("quality"))
    kept = quality.kept_of(edges, labels)
    assert kept.columns == edges.columns and set(r.doc_id for r in kept.collect()) == {1, 2, None}
    assert quality.kept_of(empty, labels).collect() == [] and quality.kept_of(edges, labels.limit(0)).count() == 4


def test_upper_bound_is_exact():
    for k, n, level in ((0, 50, 0.05), (3, 200, 0.01), (7, 40, 0.002)):
        p = quality.upper_bound(k, n, level)
        below = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(below - level) < 1e-9
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0


def kept_by_brute_force(docs, labels, risk=0.02, delta=0.05):
    """{doc_id: kept} of (doc_id, text, lang), by testing each joint setting in turn."""
    steps = [(r, g[i]) for i in range(max(map(len, quality.GRIDS.values()))) for r, g in quality.GRIDS.items() if i < len(g)]
    ratio = lambda a, b: a / b if b else 0.0

    def values(t):
        words_, lines = WHITE.findall(t), t.split("\n")
        n, chars, symbols, dup, repeat = measures(t)
        letters = sum(c.isascii() and c.isalpha() for c in t)
        upper = sum("A" <= c <= "Z" for c in t)
        bad = n < 10 or 100 * repeat > 20 * n
        found = [ratio(symbols, chars), ratio(upper, letters), ratio(t.count("!"), len(words_)), ratio(dup, len(lines)), ratio(chars, n)]
        return bad, dict(zip(("symbol_share", "upper_share", "bang_share", "repeated_line_share", "word_length"), found))

    good = {d for d, q in labels if q == 1}
    own = {d: (t or "", lang if lang in quality.STRATA else "other") for d, t, lang in docs}
    seen = {t: values(t) for t, _ in own.values()}
    setting = {}
    for name in [*quality.STRATA, "other"]:
        texts_ = {t for d, (t, lang) in own.items() if lang == name and d in good and not seen[t][0]}
        now = {}
        for rule, cutoff in steps:
            tried = now | {rule: cutoff}
            lost = sum(any(seen[t][1][r] > c for r, c in tried.items()) for t in texts_)
            # The exact upper bound is at most the risk if so few are this unlikely at the risk.
            chance = math.fsum(math.comb(len(texts_), i) * risk**i * (1 - risk) ** (len(texts_) - i) for i in range(lost + 1))
            if chance > delta / (len(quality.STRATA) + 1):
                break
            now = tried
        setting[name] = now
    return {d: not seen[t][0] and all(seen[t][1][r] <= c for r, c in setting[lang].items()) for d, (t, lang) in own.items()}, setting


def test_kept_by_brute_force(spark):
    """At the query's own risk; every language has labels enough for cutoffs."""
    folder = f"{compare.DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    # All labelled documents decide; a part of the others is judged.
    docs = docs.join(labels.select("doc_id", F.lit(1).alias("known")), "doc_id", "left").where("known = 1 or doc_id < 500").drop("known")
    given = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want, setting = kept_by_brute_force(given, [(r.doc_id, r.quality) for r in labels.collect()])
    assert all(setting[s] for s in quality.STRATA)
    table = quality.table_of(docs)
    got = quality.judge(table, quality.fit_cutoffs(table, labels))
    assert {r.doc_id: r.kept for r in got.collect()} == want


def test_cutoffs_reject_few_good_texts(spark):
    folder = f"{compare.DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    table = quality.table_of(docs)
    cutoffs = quality.fit_cutoffs(table, labels, risk=0.05)
    assert cutoffs
    judged = quality.judge(table, cutoffs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    by = {r.quality: r for r in judged}
    assert by[1].kept >= 0.95 * by[1].n and by[0].kept < 0.6 * by[0].n


# 6: licences


def test_licence_rules(spark):
    mit = [k for k in ("mit-grant", "mit-notice", "as-is")]
    full = ". ".join(licences.SENTENCES[k].capitalize() for k in mit) + "."
    cases = [
        (1, "Released under the MIT License.\nfoo", ["mit-name"], ["MIT"]),
        (2, full, mit, ["MIT"]),
        (3, "  licensed UNDER the Apache License,  Version 2.0 ! All rights -- reserved?", ["apache-name", "reserved"], ["Apache-2.0"]),
        (9, "Copyright me. All rights reserved.", ["reserved"], ["proprietary"]),
        (4, "Some words.\nnot a licence at all", [], []),
        (5, None, [], []),
        (6, "", [], []),
        (7, licences.SENTENCES["as-is"], ["as-is"], []),
        (8, full + "\nReleased under the MIT License.", mit + ["mit-name"], ["MIT", "MIT"]),
    ]
    frame = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_scan", "licences")})
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan(frame).collect()}
    assert got == {c[0]: (c[2], c[3]) for c in cases}
    pattern = licences.likely(licences.SENTENCES)
    assert all(re.search(pattern, s) for s in licences.SENTENCES.values())
    assert licences.scan(frame.limit(0)).collect() == []


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-3-Clause": """Copyright (c) 2020, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}


@pytest.mark.parametrize("before", ["", " * ", "# ", "// ", "\t"])
def test_wrapped_notices(spark, before):
    rows = [(name, "\n".join(before + x for x in text.split("\n"))) for name, text in NOTICES.items()]
    got = licences.scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert {r.name: r.licences for r in got} == {name: [name] for name in NOTICES}


def test_own_sentences(spark):
    frame = spark.createDataFrame([(1, "A b.\nFree for\nall, always!")], "doc_id long, text string")
    got = licences.scan(frame, {"free": "free for all always"}, [("own", ["free"])]).collect()
    assert [(r.sentence_ids, r.licences) for r in got] == [(["free"], ["own"])]


def test_licences_of_odd_rows(edges):
    assert all(r.licences == [] for r in licences.scan(edges).collect())


# 7: HTML


ARTICLE = "The quick brown fox jumps over the lazy dog and it runs to the river with all of its friends in the morning. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        (f"<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>Big &lt;Title&gt;</h1><p>{ARTICLE}<p>Short end.</article><footer>&copy; x</footer>", f"Big <Title>\n{ARTICLE.strip()}\nShort end."),
        (f"<body><div class='ad'>Buy now</div><div id=content><h2>Head</h2><p>{ARTICLE}</p><p>Tiny.</p><p>{ARTICLE}</p></div><div class='comments'><p>{ARTICLE}</p></div>", f"Head\n{ARTICLE.strip()}\nTiny.\n{ARTICLE.strip()}"),
        (f"<main><p>one<br>two</p><script>var a='</p>';</script><form><p>name</p></form><p>{ARTICLE}</p><aside>{ARTICLE}</aside></main>", f"one two\n{ARTICLE.strip()}"),
        ("<article><p>a < b and c > d</p><!-- x > y --><p title='>'>e&nbsp;&#8364;\n\t f</p><style>p{}</style></article>", "a < b and c > d\ne € f"),
        (f"<article><header><h1>T</h1></header><p>{ARTICLE}</p><section class='related'><p>{ARTICLE}</p></section><div role='alert'>We use cookies</div></article>", f"T\n{ARTICLE.strip()}"),
    ],
)
def test_html(page, want):
    assert html_text.main_text(page or "") == want


WRAPPERS = [
    "<div class='content has-sidebar'>{}</div>", "<div class='layout no-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>",
    "<article class='category-legal'>{}</article>", "<div class='side-by-side'><article>{}</article></div>", "<div class='modal-page'><main>{}</main></div>",
    "<div class='search-page'>{}</div>", "<form action=x><input type=hidden>{}</form>", "<form><article>{}</article></form>", "<div class='page sidebar-right'>{}</div>",
    "<div class='sidebar'><article>{}</article></div>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_wrappers(wrapper):
    rest = f"<nav><a href=x>Home</a></nav><div id='comments'><div><p>{ARTICLE}</p></div></div><form><p>Your mail</p><input><button>Go</button></form><div class='site-footer'>All of it</div>"
    page = f"<html lang=en><body>{wrapper.format(f'<h2>Head</h2><p>{ARTICLE}</p><p>Short.</p><p>{ARTICLE}</p>')}{rest}</body></html>"
    assert html_text.main_text(page) == f"Head\n{ARTICLE.strip()}\nShort.\n{ARTICLE.strip()}"


def test_html_without_article(spark):
    """The given pages with their article as a plain element: the classifier alone finds the text."""
    same = total = 0
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        bare = re.sub(r"<(/?)article>", r"<\1div>", r.html)
        got, want = (Counter(html_text.main_text(x).split("\n")) for x in (bare, r.html))
        same += sum((got & want).values())
        total += sum((got | want).values())
    assert same >= 0.9 * total


def test_html_rows(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None), (2, "v", "<p>" + "word " * 100_000)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    assert [(r.page_id, r.n_chars) for r in got.collect()] == [(1, 1), (1, 1), (None, 0), (2, 499_999)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_give_their_documents(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for r in html_text.extract(pages).collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        import html as h

        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(p for p in parts if p)


# 8: sharding


def test_slots(docs, edges, empty):
    some = docs.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    got = sharding.slots(some, [1.0] * 24).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(
        ((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in some.collect()), key=key
    )
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        by[r.shard].append((r.slot, r.doc_id is None, r.doc_id or 0))
    for own in by.values():
        own.sort()
        assert [s for s, *_ in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert sharding.slots(empty, [1.0] * 3).collect() == []


def test_weights_and_moves(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    before = {r.doc_id: r.shard for r in sharding.assign(ids, [1.0, 2.0, 5.0]).collect()}
    share = Counter(before.values())
    assert all(abs(share[i] / 40_000 - w / 8) < 0.01 for i, w in enumerate((1, 2, 5)))
    heavier = {r.doc_id: r.shard for r in sharding.assign(ids, [1.0, 3.0, 5.0]).collect()}
    assert all(heavier[d] in (s, 1) for d, s in before.items())
    gone = {r.doc_id: r.shard for r in sharding.assign(ids, [1.0, 0.0, 5.0]).collect()}
    assert all(gone[d] == s for d, s in before.items() if s != 1) and 1 not in gone.values()
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), [0.0])


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, [1.0] * 5, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().agg(F.sum("count")).first()[0] == docs.count()


# 9: decontamination


def contaminated(rows, items, width=10):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(UP))
        m = min(width, len(w))
        for i in range(len(w) - m + 1) if m else ():
            windows[tuple(w[i : i + m])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(UP))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=key)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_contamination_by_brute_force(spark, rows, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()] + [(900, "one two"), (901, None), (902, "é"), (None, "shared line of some"), (903, rows[3][1]), (903, rows[4][1][:80])]
    odd = rows + [r[:2] for r in EDGES]
    got = decontaminate.contamination(spark.createDataFrame(odd, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=key) == contaminated(odd, items)


def test_clean_rows(edges, empty, benchmark):
    items = benchmark.limit(0).unionByName(benchmark.sparkSession.createDataFrame([(1, "One, two!")], "item_id long, text string"))
    kept = decontaminate.clean_of(edges, items)
    assert kept.columns == edges.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in EDGES if r[0] not in (6, 7))
    assert decontaminate.clean_of(empty, items).collect() == []
    assert decontaminate.clean_of(edges, benchmark.limit(0)).count() == len(EDGES)


# 10: packing


def tightest(lengths, sources, clusters, capacity, per_source):
    bins, own = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [
            (b["free"], k)
            for k, b in enumerate(bins)
            if b["free"] >= lengths[i] and (clusters[i] is None or clusters[i] not in b["clusters"]) and (sources[i] is None or b["sources"][sources[i]] < per_source)
        ]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"free": capacity, "clusters": set(), "sources": Counter()})
        own[i] = k
        bins[k]["free"] -= lengths[i]
        bins[k]["clusters"].add(clusters[i])
        bins[k]["sources"][sources[i]] += 1
    return [own[i] for i in range(len(lengths))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, 3, None])), max_size=40), st.integers(1, 3))
def test_best_fit_by_brute_force(pieces, per_source):
    lengths, sources, clusters = ([p[i] for p in pieces] for i in range(3))
    own, at = packing.best_fit(np.array(lengths, dtype=np.int64), sources, clusters, 20, per_source)
    assert own.tolist() == tightest(lengths, sources, clusters, 20, per_source)


def test_packing_keeps_every_token(docs, edges, empty):
    some = docs.select("doc_id", "text", "source").unionByName(edges.select("doc_id", "text", "source"))
    capacity, per_source = 4000, 2
    got = packing.pack(some, packing.byte_length(F.col("text")), packing.exact_cluster(F.col("text")), capacity, per_source, block=64).collect()
    have = Counter()
    for r in got:
        have[r.doc_id] += r.n
    want = Counter()
    for r in some.collect():
        want[r.doc_id] += len((r.text or "").encode()) + 1
    assert have == want
    source, text = {}, {}
    for r in some.collect():
        source[r.doc_id], text[r.doc_id] = r.source, r.text
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_pos)
        end = 0
        for r in own:
            assert r.bin_pos == end
            end += r.n
        assert end <= capacity
        named = [r for r in own if r.doc_id is not None]
        assert all(c <= per_source for s, c in Counter(source[r.doc_id] for r in named).items() if s is not None)
        assert all(c == 1 for t, c in Counter(text[r.doc_id] for r in named).items() if t)
    assert packing.pack(empty, F.lit(1), F.lit(1)).collect() == []
    assert packing.pack(edges, F.lit(None), F.lit(1)).collect() == []


# Registry and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = compare.table_of([tuple(r) for r in df.collect()], df.columns)
    cur = compare.oracle(FOLDER).execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns) and got == compare.table_of(cur.fetchall(), names) and got


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, docs):
    """Each stage against its brute force, on what the one before it kept."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]

    def step(name, given):
        out = texts.written(stages[name](spark, given, FOLDER), name)
        return out, {r.doc_id: r for r in out.collect()} if name != "best_fit_packing" else out.collect()

    table = quality.table_of(docs)
    keep = {r.doc_id for r in quality.judge(table, quality.fit_cutoffs(table, labels)).where("kept").collect()}
    one, got = step("quality_rules", docs)
    assert set(got) == keep and one.columns == docs.columns
    given = sorted((d, r.text) for d, r in got.items())
    want = {d: t for d, (_, n, t) in without_repeats(given, 80, 100).items() if n == 0 or WHITE.search(t)}
    two, got = step("line_dedup", one)
    assert {d: r.text for d, r in got.items()} == want and two.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got.values())
    given = sorted(want.items())
    sets, part = linked(given, 5, 80, 100)
    want = {given[i][0] for i, p in enumerate(part) if p == i or not sets[i]}
    three, got = step("ngram_jaccard_join", two)
    assert set(got) == want and three.columns == docs.columns
    want = {r[0] for r in contaminated([(d, r.text) for d, r in got.items()], items) if not r[-1]}
    four, got = step("benchmark_decontamination", three)
    assert set(got) == want and four.columns == docs.columns and got
    _, bins = step("best_fit_packing", four)
    have = Counter()
    for r in bins:
        have[r.doc_id] += r.n
    assert have == Counter({d: len(r.text.encode()) + 1 for d, r in got.items()})
    assert corpus_pipeline.run(spark, FOLDER).count() == len(bins)


def test_pipeline_stages_on_odd_rows(spark, edges, empty):
    clash = {c: F.lit("mine") for c in ("n_lines", "n_removed", "_removed", "lines", "found", "items", "bin_id", "n")}
    odd = edges.drop("n_chars").withColumns({"n_chars": F.length("text").cast("long"), **clash})
    none = empty.drop("n_chars").withColumns({"n_chars": F.length("text").cast("long"), **clash})
    ids = {
        "quality_rules": Counter({1: 2, 2: 1, None: 1}),
        # 2 repeats 1 as a whole, and so does the row without an id; 7 repeats 6, and 9 repeats 8.
        "line_dedup": Counter({1: 2, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 10: 1}),
        "ngram_jaccard_join": Counter({1: 2, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 10: 1}),
        "benchmark_decontamination": Counter(r[0] for r in EDGES),
    }
    for name, stage in corpus_pipeline.STAGES:
        got = texts.written(stage(spark, odd, FOLDER), name)
        rows = got.collect()
        if name == "best_fit_packing":
            assert sum(r.n for r in rows) == sum(len((t or "").encode()) + 1 for _, t, _, _ in EDGES)
        else:
            assert got.columns == odd.columns, name
            assert Counter(r.doc_id for r in rows) == ids[name], name
            assert all(r[c] == "mine" for r in rows for c in clash) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
        assert stage(spark, none, FOLDER).collect() == [], name
