"""Importance resampling, language identification and conversation repair against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import compare
from reachgrid.llm import conversations, crc_grams, edit_lattice, language_id, queries, resampling, words

FOLDER = f"{compare.DATA}/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK = re.compile("[^\x20\x09-\x0d]")
LONG = "lorem ipsum dolor sit amet " * 40_000
#: Names that an operator might use itself.
CLASH = ["down", "no_id", "id", "rid", "n", "lang_pred", "score", "ambiguous", "_language", "rank", "weight", "state", "there", "pos", "key", "k1"]


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


# 11: importance resampling


def test_checksums_of_runs():
    rng = random.Random(3)
    for _ in range(40):
        own = [bytes(rng.choice(b"abcXYZ019\xc3\xa9") for _ in range(rng.choice([1, 2, 7, 63, 64, 65, 130, 5000]))) for _ in range(rng.randrange(12))]
        text = b" . ".join(own) + b" !"
        raw = np.frombuffer(text, dtype=np.uint8)
        start, end, first = crc_grams.spans(raw, np.array([0, len(raw)]), words.NOT_ALNUM)
        assert [text[a:b] for a, b in zip(start, end)] == own and first.tolist() == [0, len(own)]
        for k, crc in enumerate(crc_grams.run_checksums(raw, start, end, 4), 1):
            assert crc.tolist() == [zlib.crc32(b" ".join(own[i : i + k])) for i in range(len(own) - k + 1)]


def drawn_by_brute_force(docs, target, share=(5, 100), least=20, buckets=10_000):
    def features(t):
        w = ALNUM.findall((t or "").translate(UP))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1))

    own = [features(t) for _, t in docs]
    s, t = Counter(), Counter()
    for _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for (d, _), (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        rows.append((d, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = order[: share[0] * len(order) // share[1]]
    out = Counter((*r, i) for i, r in enumerate(drawn, 1))
    rest = Counter(rows) - Counter(drawn)
    return out + Counter({(*r, None): n for r, n in rest.items()})


@pytest.mark.parametrize("share, chunk", [((5, 100), 1 << 20), ((37, 100), 16), ((1, 1), 64)])
def test_draw_by_brute_force(spark, share, chunk):
    docs, target = table(spark, "documents"), table(spark, "benchmark")
    got = resampling.resample(docs.repartition(5), target, share, chunk=chunk)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in got.collect()) == drawn_by_brute_force(rows, [r.text for r in target.collect()], share)


def test_draw_of_odd_rows(spark):
    text = "one two three four five six seven eight nine ten " * 3
    odd = [(1, text), (1, text), (1, text + "x"), (None, text), (None, None), (None, text), (2, None), (3, ""), (4, " .,\n"), (5, LONG), (6, "w" * 70_000), (7, "É é ü 中文 " * 9), (8, text)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH}).repartition(3)
    target = spark.createDataFrame([(text,), (None,), ("",)], "text string").withColumns({c: F.lit("x") for c in CLASH})
    for share in ((1, 2), (0, 1), (1, 1)):
        got = resampling.resample(docs, target, share, chunk=2)
        assert Counter(tuple(r) for r in got.collect()) == drawn_by_brute_force(odd, [text], share)
    assert resampling.resample(docs.limit(0), target).collect() == []
    flat = resampling.resample(docs, target.limit(0), (1, 2))
    assert Counter(tuple(r) for r in flat.collect()) == drawn_by_brute_force(odd, [], (1, 2))


def test_cutoff_is_the_key_of_its_rank(spark):
    rng = random.Random(8)
    for n in (1, 2, 3, 50, 400):
        scores = [rng.randrange(12) for _ in range(n)]
        frame = spark.createDataFrame([(s, i % 7 if i % 5 else None, i) for i, s in enumerate(scores)], "score long, doc_id long, rid long").repartition(4)
        order = sorted((-s, int(i % 5 == 0), i % 7 if i % 5 else 0, i) for i, s in enumerate(scores))
        for num in (1, 3, 10):
            k = num * n // 10
            assert resampling.cutoff(resampling._keys(frame), (num, 10), chunk=9) == (order[k - 1] if k else None)


# 12: language identification


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 9, 30):
        code = language_id.codewords(n)
        distance = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert distance >= (1 if n == 2 else code.shape[1] // 4)
        assert all(0 < column.sum() < n for column in code.T)
    assert language_id.codewords(1).shape == (1, 0) and language_id.codewords(0).shape == (0, 0)


def test_held_out_accuracy(spark):
    folder = f"{compare.DATA}/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op12_language_id"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    for side in (True, False):
        own = [r for r in got if r.held_out == side]
        assert sum(r.lang_pred == truth[r.doc_id].lang for r in own) >= 0.98 * len(own)
    sure = [r for r in got if not r.ambiguous]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in sure) >= 0.99 * len(sure)


def test_predictions_depend_on_the_text_alone(spark):
    docs = table(spark, "documents").select("doc_id", "text", "lang", "source")
    taught = docs.select("lang", "text", F.xxhash64("doc_id").alias("key"))
    model = language_id.fit(taught, sample=30)
    again = language_id.fit(taught.repartition(7), sample=30)
    assert model.languages == again.languages and (model.weights == again.weights).all() and np.allclose(model.slope, again.slope)
    hidden = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("x").alias("source"))

    def told(df):
        return sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.predict(df, model).collect())

    assert told(docs) == told(hidden.repartition(3))


def test_more_languages_than_dichotomies(spark):
    rng = random.Random(2)
    rows = []
    for i in range(10):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        rows += [(f"l{i}", " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30)), rng.getrandbits(62)) for _ in range(20)]
    frame = spark.createDataFrame(rows, "lang string, text string, key long")
    got = language_id.predict(frame, language_id.fit(frame)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_languages_of_odd_rows(spark):
    odd = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (4, "中文字", "fr"), (5, "x", None), (None, "the of and", "en"), (None, None, None), (7, LONG, "en"), (7, LONG, "en"), (8, "É", "fr"), (9, "a\x00b", "")]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in CLASH}).repartition(3)
    docs = table(spark, "documents").select("doc_id", "text", "lang").withColumns({c: F.lit("x") for c in CLASH})
    got = language_id.identify(docs.unionByName(frame)).collect()
    assert len(got) == docs.count() + len(odd)
    model = language_id.fit(docs.select("lang", "text", F.xxhash64("doc_id").alias("key")))
    found = language_id.predict(frame, model)
    assert found.columns == [*[c for c in frame.columns if c not in ("lang_pred", "score", "ambiguous")], "lang_pred", "score", "ambiguous"]
    named = [(r.text, r.lang_pred, r.score, r.ambiguous) for r in found.collect()]
    for text, lang, score, ambiguous in named:
        if not text or text == "123 !?":
            assert (lang, score, ambiguous) == ("und", 0.0, True)
        else:
            assert lang in model.languages and 0 < score <= 1
    nothing = language_id.identify(frame.limit(0))
    assert nothing.collect() == [] and nothing.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(unlabelled).collect()} == {("und", 0.0)}
    one = language_id.identify(frame.withColumn("lang", F.lit("xx"))).collect()
    assert {r.lang_pred for r in one} == {"und", "xx"}


# 13: conversation repair


def least_by_recursion(codes):
    @lru_cache(None)
    def best(i, q, inserted):
        options = [(0, "")] if i == len(codes) and q in (0, 3) else []
        if i < len(codes):
            kind, torn = codes[i] & 3, 3 if codes[i] & 8 else 0
            if not codes[i] & 4:
                after = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}.get((q, kind))
                if after is not None:
                    c, s = best(i + 1, after, 0)
                    options.append((c + torn, "K" + s))
                c, s = best(i + 1, 3 if q == 2 else 2, 0)
                options.append((c + 3 + torn, "R" + s))
            c, s = best(i + 1, q, 0)
            options.append((c + 4, "D" + s))
        if inserted < 3:
            c, s = best(i, 3 if q == 2 else 2, inserted + 1)
            options.append((c + 3, "I" + s))
        return min(options, default=(1 << 40, "~"))

    return best(0, 0, 0)


def test_least_edits_by_recursion():
    rng = random.Random(1)
    for _ in range(3000):
        codes = bytes(rng.choice([0, 1, 2, 2, 3, 3]) | rng.choice([0, 0, 0, 4, 8]) for _ in range(rng.randrange(10)))
        want = least_by_recursion(codes)
        assert edit_lattice.search(codes, 0, edit_lattice.ENDS) == want == edit_lattice.least_edits(codes)
        a, b = sorted(rng.randrange(len(codes) + 1) for _ in range(2))
        assert edit_lattice.joined([edit_lattice.ways(x) for x in (codes[:a], codes[a:b], codes[b:])]) == want


def repaired_by_brute_force(rows, damage=True):
    """The contract, conversation by conversation, over (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        own = groups[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, counts = set(), [], Counter()
        for _, role, text in own:
            marks = BLANK.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) | {"blank": 4, "duplicate": 4, "truncated": 8}.get(fault, 0))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = least_by_recursion(bytes(codes))
        made, i, state = [], 0, 0
        for letter in audit:
            if letter in "RI":
                state = 3 if state == 2 else 2
                made.append(("user" if state == 2 else "assistant") + ":" + (own[i][2] if letter == "R" else ""))
            elif letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[own[i][1][:1]]
                made.append(f"{own[i][1]}:{own[i][2]}")
            i += letter != "I"
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest, made)
    return out


ODD = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 4, "user", "no end"),
    (None, 1, "user", "Lost?"), (None, None, None, None), (None, None, "assistant", "x."),
    (2, None, "system", "Be kind."), (2, None, "user", "a\nb."), (2, 7, "tool", "t."), (2, 8, "", "e."), (2, 9, "assistant", "ok.\n \t"),
    (3, 0, "user", None), (4, 0, None, "a."), (5, 0, "system", "only."), (6, 0, "assistant", "a."), (6, -3, "user", "b?"),
    (7, 0, "user", LONG), (7, 1, "assistant", LONG + "."), (8, 0, "user", "\x85 \xa0"), (9, 0, "user", "q."), (9, 1, "assistant", "q."), (9, 2, "user", "q."),
]


def conversations_of(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return frame.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.mark.parametrize("limits", [{}, {"most_turns": 2, "segment": 3}, {"most_bytes": 40, "segment": 2}])
def test_repair_by_brute_force(spark, limits):
    rng = random.Random(6)
    texts = ["A.", "B?", "c", "", " \n", "d!", "e\t."]
    made = [(100 + rng.randrange(60), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "user", "assistant", "bot"]), rng.choice(texts)) for _ in range(400)]
    given = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, "conversations").collect()]
    rows = ODD + made + given
    want = repaired_by_brute_force(rows)
    repair = conversations.Repair(conversations.damaged(conversations_of(spark, rows)), **limits)
    got = repair.report().collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: v[:-1] for c, v in want.items()}
    lines = defaultdict(list)
    for r in sorted(repair.turns().collect(), key=lambda r: r.place):
        assert r.place == len(lines[r.conv_id]) and r.edit in "KRI"
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: x for c, x in lines.items()} == {c: v[-1] for c, v in want.items() if v[-1]}


def test_repair_without_damage(spark):
    want = repaired_by_brute_force(ODD, damage=False)
    got = conversations.Repair(conversations.turns_of(conversations_of(spark, ODD))).report().collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: v[:-1] for c, v in want.items()}


def test_repair_of_nothing(spark):
    empty = conversations_of(spark, ODD).limit(0)
    repair = conversations.Repair(conversations.damaged(empty))
    assert repair.report().collect() == [] and repair.turns().collect() == []
    # Every turn of conversation 0 is dropped; it is reported all the same.
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    only = conversations.Repair(conversations.damaged(conversations_of(spark, [(*gone, "user", "Hi.")]))).report().collect()
    assert [tuple(r) for r in only] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
