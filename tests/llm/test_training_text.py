"""The training-text operators on small cases: brute force, round trips, nulls, empty tables, repeated rows, clashing names."""

import base64
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("inkstone.llm")

from inkstone.functions.glyphs import fold  # noqa: E402
from inkstone.llm import bisect_split as SP  # noqa: E402
from inkstone.llm import cut_detect as CD  # noqa: E402
from inkstone.llm import glyph_unify as GU  # noqa: E402
from inkstone.llm import leak_search as LS  # noqa: E402
from inkstone.llm import mix_sources as MX  # noqa: E402
from inkstone.llm import near_duplicates as ND  # noqa: E402
from inkstone.llm import quality_stats as QS  # noqa: E402
from inkstone.llm.batches import slices  # noqa: E402

RNG = random.Random(5)
WORDS = "收入 成本 增长 下滑 项目 公司 市场 政策 电池 芯片 需求 价格 产能 利润 研发 物流 补贴 同比 环比 预期 海外 渠道 订单 客户 材料 设备".split()


def prose(n, rng=RNG):
    out = ""
    while len(out) < n:
        out += "".join(rng.choice(WORDS) for _ in range(rng.randint(4, 9))) + rng.choice("，，。") + ("" if rng.random() < 0.9 else "\n")
    return out[: n - 1] + "。"


def test_slices():
    texts = ["a" * n for n in (5, 5, 5, 50, 1, 1)]
    assert list(slices(texts, rows=2, chars=20)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(slices([])) == []


# --- 1: look-alikes


def test_union_find_is_transitive():
    classes = GU.look_alike_classes([("a", "b"), ("b", "c"), ("x", "y")])
    assert sorted(map(sorted, classes)) == [["a", "b", "c"], ["x", "y"]]


def test_sequences_follow_their_letters():
    classes = GU.look_alike_classes([("é", "é"), ("e", "е")])
    assert {"é", "é", "е́"} <= set(next(c for c in classes if "é" in c))


@pytest.mark.parametrize("text,plain", [("ＲＯＩＣ", "ROIC"), ("⻛险提⽰", "风险提示"), ("Trésorerie", "Trésorerie"), ("Рrоﬁt", "Profit"), ("a​﻿b", "ab"), ("x y", "x y"), ("Debt−to‐equity", "Debt-to-equity"), ("", ""), ("m²", "m²"), ("Ｅ́", "É"), ("한", "한")])
def test_rewriting(text, plain):
    frequent = GU.Rewriter(GU.look_alike_classes(), {c: 9 for c in map(chr, range(32, 127))} | {c: 9 for c in "éÉ风险示한"} | {"fi": 9})
    assert frequent.rewrite(text) == plain
    assert frequent.rewrite(frequent.rewrite(text)) == frequent.rewrite(text)


def test_representative_is_the_frequent_one():
    classes = GU.look_alike_classes([("(", "（")])
    assert GU.Rewriter(classes, {"（": 5, "(": 1}).rewrite("a(b") == "a（b"
    assert GU.Rewriter(classes, {"（": 1, "(": 5}).rewrite("a（b") == "a(b"


def test_disguised_terms(spark):
    items = spark.createDataFrame(
        [("box", "b1", " ＲＯＩＣ "), ("box", "b1", " ＲＯＩＣ "), ("box", "b2", "ROIC"), ("cell", "c1", "R​OIC"), ("cell", "c2", None), ("cell", None, "ＲＯＩＣ"), ("cell", "c3", ""), ("cell", "c4", "ROIC" * 30000)],
        "item_kind string, item_id string, text string",
    ).selectExpr("*", "1 as term_id", "'x' as looks", "'y' as term")
    terms = spark.createDataFrame([(1, "ROIC", "ratio"), (2, None, None)], "term_id bigint, term string, measure string")
    rewriter = GU.corpus_rewriter(items)
    found = {tuple(r) for r in GU.disguised_terms(items, terms, rewriter).collect()}
    assert found == {("box", "b1", 1), ("cell", "c1", 1)}
    assert GU.disguised_terms(items.limit(0), terms, rewriter).count() == 0
    assert {r.text: r.looks for r in GU.unify(items, "text", rewriter, "looks").collect()}[None] is None


@pytest.mark.parametrize("blank", ["\u3000", "\xa0", " "])
def test_disguised_terms_whatever_blank_is_frequent(spark, blank):
    items = spark.createDataFrame([("box", "b1", " ＲＯＩＣ "), ("box", "b2", " ROIC "), ("box", "b3", f"{blank}ＲＯＩＣ{blank}"), ("box", "pad", blank * 50 + "x"), ("box", "word", "ROIC" * 9)], "item_kind string, item_id string, text string")
    terms = spark.createDataFrame([(1, "ROIC")], "term_id bigint, term string")
    assert {r.item_id for r in GU.disguised_terms(items, terms, GU.corpus_rewriter(items)).collect()} == {"b1", "b3"}


def test_unify_agrees_with_fold_on_random_texts():
    pool = [a for a, _ in GU.look_alike_pairs()][::7] + list("abcEPO收入（）() -é")
    rewriter = GU.Rewriter(GU.look_alike_classes(), {c: 9 for c in map(chr, range(32, 127))} | {"ff": 9, "fi": 9, "fl": 9, "ffi": 9, "ffl": 9})
    for _ in range(400):
        a = "".join(RNG.choice(pool) for _ in range(6))
        b = fold(a)
        assert rewriter.rewrite(a) == rewriter.rewrite(b), (a, b)


# --- 3: statistics


def _junk(rng):
    return "".join(rng.choice("#@!~^&*{}[]<>|\\/=+") for _ in range(200))


def _list(rng):
    return "\n".join(f"{k}. " + "".join(rng.choice(WORDS) for _ in range(3)) for k in range(1, 9))


def _table(rng):
    return "\n".join("| " + rng.choice(WORDS) + " | " + " | ".join(f"{rng.random() * 9000:,.1f}" for _ in range(4)) + " |" for _ in range(7))


def test_kinds_on_held_out_rows(spark):
    rng = random.Random(2)
    make = {"prose": lambda: prose(300, rng), "list": lambda: _list(rng), "table": lambda: _table(rng), "junk": lambda: _junk(rng)}
    rows, labels, truth = [], [], {}
    for k in range(400):
        kind = "prose" if k % 2 else ["list", "table", "junk"][k // 2 % 3]
        rows.append((f"c{k}", "text" if k % 3 else None, make[kind]()))
        truth[f"c{k}"] = kind
        if k < 160:
            labels.append((f"c{k}", kind))
    rows += [("blank", "text", "  "), ("null", "text", None), ("c1", "text", rows[1][2]), ("long", "text", prose(200_000, rng)), (None, "text", "x"), ("t", "title", _junk(rng))]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_type string, text string").selectExpr("*", "1 as words", "'x' as kind", "true as blank", "'q' as language")
    marked = spark.createDataFrame(labels + [(None, "junk"), ("zzz", "nonsense")], "chunk_id string, kind string").selectExpr("*", "'t' as text")
    got = {r.chunk_id: r.kind for r in QS.not_prose(chunks, marked).collect()}
    assert got.pop("blank") == got.pop("null") == "junk" and "t" not in got and "long" not in got
    right = sum(got.get(c, "prose") == kind for c, kind in truth.items())
    assert right / len(truth) > 0.97
    assert QS.not_prose(chunks.limit(0), marked).count() == 0
    assert {r.kind for r in QS.not_prose(chunks, marked.limit(0)).collect()} == {"junk"}


def test_scores_are_robust():
    known = {"zh": np.tile(np.linspace(0, 1, len(QS.GRID)), (len(QS.STATS), 1))}
    values = np.full((2, len(QS.STATS)), 0.5)
    values[1] = 5
    percent, z = QS.scores(values, np.array(["zh", "zh"], object), known)
    assert np.allclose(z[0], 0) and (z[1] > 3).all() and (percent[1] > 0.97).all()


def _exact(values):
    """Middle ranks: the share of smaller values and half of the equal ones."""
    order = np.sort(values)
    return (np.searchsorted(order, values, "left") + np.searchsorted(order, values, "right")) / 2 / len(values)


@pytest.mark.parametrize("kind", ["normal", "tied", "mostly zero"])
def test_percentiles_against_exact_ranks(spark, kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(size=30_000), "tied": rng.integers(0, 9, 30_000), "mostly zero": np.where(rng.random(30_000) < 0.96, 0, rng.random(30_000))}[kind].astype(np.float32)
    rows = spark.createDataFrame([(f"c{k}", False, "ko" if k % 500 == 0 else "zh" if k % 3 else "latin", float(v)) for k, v in enumerate(x)], "chunk_id string, blank boolean, language string, v float")
    known = QS.quantiles(rows.select("chunk_id", "blank", "language", *(F.col("v").alias(s) for s in QS.STATS)))
    assert set(known) == {"zh", "latin", "ko"} and not np.array_equal(known["ko"], known["zh"])
    for name, at in (("zh", [k % 500 != 0 and k % 3 != 0 for k in range(len(x))]), ("latin", [k % 500 != 0 and k % 3 == 0 for k in range(len(x))])):
        percent, _ = QS.scores(np.tile(x[at, None], (1, len(QS.STATS))), np.full(sum(at), name, object), known)
        exact = _exact(x[at])
        assert np.abs(percent[:, 0] - exact).max() <= 0.01
        low, high = QS.tails(percent)
        assert ((exact < 0.02) <= low[:, 0]).all() and ((exact > 0.98) <= high[:, 0]).all() and (low[:, 0] <= (exact < 0.03)).all() and (high[:, 0] <= (exact > 0.97)).all()


def test_rank_errors_by_counts(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(4_000) < 0.5, 0, rng.random(4_000)).astype(np.float32)
    rows = spark.createDataFrame([(f"c{k}", k % 400 == 0, "zh" if k % 3 else "latin", float(v)) for k, v in enumerate(x)], "chunk_id string, blank boolean, language string, v float").select("chunk_id", "blank", "language", *(F.col("v").alias(s) for s in QS.STATS))
    known = QS.quantiles(rows, own_only=True)
    got = {(r.language, r.statistic): (r.n, r.error) for r in QS.rank_errors(rows, known).collect()}
    assert len(got) == 2 * len(QS.STATS)
    for name, part in (("zh", [k % 3 != 0 and k % 400 != 0 for k in range(4000)]), ("latin", [k % 3 == 0 and k % 400 != 0 for k in range(4000)])):
        v, q = np.sort(x[part]), known[name][0]
        error = max(max(np.searchsorted(v, a, "left") / len(v) - g, g - np.searchsorted(v, a, "right") / len(v), 0) for a, g in zip(q, QS.GRID))
        assert got[name, "words"][0] == len(v) and abs(got[name, "words"][1] - error) < 1e-9 and error <= 0.01
    shifted = {n: q + 0.1 for n, q in known.items()}
    assert min(r.error for r in QS.rank_errors(rows, shifted).collect()) > 0.04


def test_languages():
    texts = ["公司收入增长 EBITDA", "これは日本語の文章です", "hello world", "이것은 한국어", "это русский", "ελληνικά", "مرحبا", "12345", "שלום", "नमस्ते", "สวัสดี"]
    _, found = QS.statistics(texts, np.zeros((2, QS.BUCKETS)), np.zeros(0x110000, bool))
    assert [QS.LANGUAGES[k] for k in found] == ["zh", "ja", "latin", "ko", "cyrillic", "greek", "arabic", "latin", "hebrew", "devanagari", "thai"]


def test_statistics_have_tail_flags(spark):
    rng = random.Random(5)
    chunks = spark.createDataFrame([(f"c{k}", "text", prose(200 + k, rng)) for k in range(200)] + [("long", "text", prose(90_000, rng))], "chunk_id string, chunk_type string, text string")
    marked = spark.createDataFrame([("c1", "prose"), ("c2", "list")], "chunk_id string, kind string")
    rows = {r.chunk_id: r for r in QS.kinds(QS.described(chunks), marked, with_scores=True).collect()}
    assert rows["long"].words_high and not rows["long"].words_low and rows["long"].words_z > 30
    assert 2 <= sum(r.words_high for r in rows.values()) <= 8 and 2 <= sum(r.words_low for r in rows.values()) <= 8


# --- 4: splitting


@pytest.mark.parametrize("limit,overlap", [(100, 20), (60, 0), (512, 80), (100, 80), (50, 49)])
def test_pieces_hold_together(limit, overlap):
    for n in (limit + 1, 5 * limit, 3000):
        text = prose(n)
        cut, pieces = SP.split_text(text, limit, overlap)
        assert all(0 < b - a <= limit for a, b in pieces)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(p[1] - q[0] == overlap for p, q in zip(pieces, pieces[1:]))
        assert cut == ("forced" if max(len(x) for x in re.split(r"(?<=。)", text)) > limit else "boundary")


@pytest.mark.parametrize("limit,overlap", [(100, 80), (100, 0), (10, 9), (7, 3), (1, 0), (2, 1)])
def test_forced_cuts_keep_the_overlap(limit, overlap):
    for text in ("x" * 250, "e\u0301" * 130, "a b" * 90, "字，" * 120):
        cut, pieces = SP.split_text(text, limit, overlap)
        assert cut == "forced" and pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in pieces) and all(p[1] - q[0] == overlap and p[0] < q[0] and p[1] < q[1] for p, q in zip(pieces, pieces[1:]))
    assert len(SP.split_text("x" * 250, 100, 80)[1]) <= 17


def test_cuts_fall_on_natural_boundaries():
    text = "\n\n".join("句子一二三四五六七八九十。" * 3 for _ in range(8))
    _, pieces = SP.split_text(text, 90, 0)
    at = SP.natural_boundaries(text)
    assert all(a in at and b in at for a, b in pieces)
    assert SP.split_text("x" * 250, 100, 10)[0] == "forced"
    rows = ["a" * 30, "b" * 30, "c" * 30]
    pieces = SP.split_text("\n".join(rows), 65, 0, [30, 61, 92])[1]
    assert len(pieces) == 2 and pieces[0][1] in (30, 61)
    with pytest.raises(ValueError):
        SP.split_text("abc", 5, 5)


def test_sentence_ends():
    text = "他说：“好。”然后 3.5 走。Really?” Yes! a.b"
    ends = {text[:p][-3:] for p, s in SP.natural_boundaries(text).items() if s == 1}
    assert ends == {"好。”", " 走。"[-3:], "y?”", "es!"}


def test_split_items(spark):
    things = spark.createDataFrame(
        [("section", "s1", "句子。" * 100, None, 1), ("section", "s1", "句子。" * 100, None, 2), ("section", "s2", "短。", None, 1), ("section", "s3", None, None, 1), ("section", None, "句子。" * 100, None, 1), ("other", "o", "句子。" * 100, None, 1), ("table", "t", "a" * 50 + "\n" + "b" * 90, [50, 141], 1)],
        "item_kind string, item_id string, text string, row_ends array<int>, at int",
    ).selectExpr("*", "7 as max_chars", "'x' as cut")
    limits = spark.createDataFrame([("section", 100, 10), ("table", 80, 0), ("page", None, 0)], "item_kind string, max_chars int, overlap_chars int")
    rows = SP.split_items(things, limits).collect()
    assert {(r.item_id, r.cut) for r in rows} == {("s1", "boundary"), ("t", "forced")}
    assert sum(r.item_id == "s1" for r in rows) == max(r.piece for r in rows if r.item_id == "s1")
    whole = {r.item_id: r for r in SP.rebuilt(SP.split_items(things, limits)).collect()}
    assert whole["s1"].text == "句子。" * 100 and whole["s1"].longest <= 100 and whole["s1"].overlaps == [10] and whole["t"].text == "a" * 50 + "\n" + "b" * 90
    assert SP.split_items(things.limit(0), limits).count() == 0 and SP.split_items(things, limits.limit(0)).count() == 0


# --- 5: near-duplicates


def _edited(text, rng, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = text[:k] + rng.choice(["", "仍", "其实"]) + text[k + rng.randint(0, 1) :]
    return text


def test_duplicate_pairs_against_brute_force(spark):
    rng = random.Random(9)
    texts = {f"d{k:03d}": prose(400, rng) for k in range(60)}
    for k in range(0, 30, 3):
        base = texts[f"d{k:03d}"]
        texts[f"e{k:03d}"] = _edited(base, rng, 4)
        texts[f"f{k:03d}"] = base[200:] + base[:200]
    texts["g"] = texts["d001"]
    clean = {k: ND.solid(t) for k, t in texts.items()}
    names = sorted(clean)
    near = {n: {n} for n in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if ND.share_within(clean[a], clean[b]) >= ND.SHARE:
                near[a].add(b), near[b].add(a)
    expected = {(a, b) for n in names for a in near[n] for b in near[n] if a < b}
    rows = [*texts.items(), ("g", texts["g"]), ("n", None), (None, texts["g"]), ("s", "短"), ("long", prose(50_000, rng))]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").selectExpr("*", "1 as text_key", "'x' as keys", "2 as a")
    assert {tuple(r) for r in ND.duplicate_pairs(chunks).collect()} == expected and len(expected) >= 21
    groups = {r.chunk_id: r.class_id for r in ND.groups(chunks).collect()}
    assert all(groups[a] == groups[b] for a, b in expected) and len(set(groups.values())) == len(groups) - sum(len(c) - 1 for c in {frozenset(v) for v in _closed(near).values()})
    assert ND.duplicate_pairs(chunks.limit(0)).count() == 0 and ND.groups(chunks.limit(0)).count() == 0


def _closed(near):
    out = {n: {n} for n in near}
    for _ in near:
        out = {n: set().union(*(near[m] | out[m] for m in out[n])) for n in near}
    return out


def test_hot_block_is_dealt_into_cells(spark):
    rng = random.Random(4)
    base = prose(300, rng)
    made = {_edited(base, rng, 1) for _ in range(60)}
    chunks = spark.createDataFrame([(f"h{k:03d}", t) for k, t in enumerate(sorted(made))], "chunk_id string, text string")
    texts = ND.distinct_texts(ND.sketched(chunks))
    small, large, split = ({tuple(r) for r in ND.candidate_pairs(texts, cell=c, hot=h).collect()} for c, h in ((8, 99), (256, 99), (8, 20)))
    assert small == large == split and len(small) == len(made) * (len(made) - 1) // 2


def test_hot_block_keeps_pairs_that_meet_in_one_band(spark):
    rng = random.Random(8)
    base = prose(300, rng)
    rows = [(f"h{k:03d}", t) for k, t in enumerate(sorted({_edited(base, rng, 1) for _ in range(60)}))] + [(f"o{k}", prose(300, rng)) for k in range(9)]
    texts = ND.distinct_texts(ND.sketched(spark.createDataFrame(rows, "chunk_id string, text string")))
    texts = texts.select("text_key", "n", *ND.WORDS, F.lit(7).cast("bigint").alias("k0"), *(F.xxhash64("text_key", F.lit(k)).alias(k) for k in ND.KEYS[1:]))
    prints = {r.text_key: np.array(r[2:6], np.int64).view(np.uint64) for r in texts.collect()}
    near = {(a, b) for a in prints for b in prints if a < b and np.bitwise_count(prints[a] ^ prints[b]).sum() <= ND.RADIUS}
    assert len(near) >= (len(rows) - 9) * (len(rows) - 10) // 2
    for cell, hot in ((8, 99), (8, 20), (1, 20)):
        assert {tuple(r) for r in ND.candidate_pairs(texts, cell=cell, hot=hot).collect()} == near


@pytest.mark.parametrize("centres", [2, 900])
def test_large_block_against_brute_force(centres):
    rng = np.random.default_rng(centres)
    draw = lambda *shape: rng.integers(0, 1 << 63, shape, dtype=np.uint64)
    prints = draw(centres, 4)[rng.integers(0, centres, (2, 1100))] ^ (draw(2, 1100, 4) & draw(2, 1100, 4) & draw(2, 1100, 4))
    own = rng.integers(0, 2, (2, 1100))
    a, b, tally = ND.block_pairs(np.arange(2200).reshape(2, 1100), own, np.array([False, True]), prints)
    near = set()
    for g in range(2):
        apart = sum(np.bitwise_count(prints[g, :, None, w] ^ prints[g, None, :, w]).astype(int) for w in range(4))
        wanted = np.triu(apart <= ND.RADIUS, 1) & (np.full((1100, 1100), g == 0) | (own[g, :, None] != own[g]))
        near |= {(int(x) + 1100 * g, int(y) + 1100 * g) for x, y in zip(*np.nonzero(wanted))}
    assert set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) == near and len(a) == len(near) == tally[2]
    assert tally[0] == 1100 * 1099 // 2 + own[1].sum() * (1100 - own[1].sum())


@pytest.mark.parametrize("pivots", [1, 3, 8])
def test_block_pairs_against_brute_force(pivots):
    rng = np.random.default_rng(pivots)
    centres = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
    prints = centres[rng.integers(0, 3, (5, 40))] ^ (rng.integers(0, 1 << 63, (5, 40, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (5, 40, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (5, 40, 4), dtype=np.uint64))
    texts, own, mixed = np.arange(200).reshape(5, 40), rng.integers(0, 2, (5, 40)), np.array([False, True, False, True, False])
    a, b, tally = ND.block_pairs(texts, own, mixed, prints, 72, pivots)
    every = [(g, i, j) for g in range(5) for i in range(40) for j in range(i + 1, 40) if not mixed[g] or own[g, i] != own[g, j]]
    near = {(int(texts[g, i]), int(texts[g, j])) for g, i, j in every if sum(map(int, np.bitwise_count(prints[g, i] ^ prints[g, j]))) <= 72}
    assert set(zip(a.tolist(), b.tolist())) == near and tally[0] == len(every) and tally[2] == len(near) and 0 < tally[1] <= len(every) - len(near)


def test_pivots_discard_what_is_far_apart(spark):
    rng = random.Random(12)
    shared = prose(260, rng)
    rows = [(f"c{k:03d}", shared + prose(500, rng)) for k in range(80)]
    texts = ND.distinct_texts(ND.sketched(spark.createDataFrame(rows + [(f"d{i}", _edited(t, rng, 2)) for i, t in rows], "chunk_id string, text string")))
    drawn, discarded, kept = ND.pivot_tally(texts)
    assert drawn > kept + 20 and discarded > 0.5 * (drawn - kept)


@pytest.mark.parametrize("n,cell", [(100, 2048), (101, 16), (1500, 200)])
def test_many_copies(spark, n, cell):
    rng = random.Random(6)
    base = prose(300, rng)
    other = _edited(base, rng, 2)
    copies = [f"k{k:04d}" for k in range(n)]
    chunks = spark.createDataFrame([(c, base) for c in copies] + [("z1", other), ("z2", other)], "chunk_id string, text string")
    pairs = ND.duplicate_pairs(chunks, cell)
    everything = n * (n - 1) // 2 + 2 * n + 1
    if n < 1000:
        assert sorted(map(tuple, pairs.collect())) == sorted((a, b) for k, a in enumerate(copies + ["z1", "z2"]) for b in (copies + ["z1", "z2"])[k + 1 :])
    assert pairs.count() == pairs.distinct().count() == everything
    rows = ND.groups(chunks).collect()
    assert {r.class_id for r in rows} == {"k0000"} and {r.text_id for r in rows} == {"k0000", "z1"} and {r.links for r in rows} == {1} and len(rows) == n + 2
    assert [tuple(r) for r in ND.text_links(chunks).collect()] == [("k0000", "z1")]


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.label for r in ND.components(chain).collect()} == {0, 100}


# --- 6: leaks


def test_leaks_against_brute_force():
    rng = random.Random(7)
    items = [(k, prose(rng.choice([3, 12, 30, 80]), rng), prose(rng.choice([5, 40, 120]), rng)) for k in range(30)] + [(90, None, ""), (91, "。。", None)]
    docs = []
    for _ in range(150):
        _, q, a = rng.choice(items[:30])
        start = rng.randrange(max(1, len(a)))
        part = rng.choice([q, a, a[start : start + rng.randint(5, 90)], ""])
        docs.append(prose(60, rng) + "\n" + " ".join(part) + prose(40, rng))
    index = LS.LeakIndex(items)
    for text in [*docs, "", None, "x"]:
        t, expected = LS.skeleton(text), set()
        for k, q, a in items:
            q, a = LS.skeleton(q), LS.skeleton(a)
            half = (len(a) + 1) // 2
            if q and q in t or a and any(a[i : i + half] in t for i in range(len(a) - half + 1)):
                expected.add(k)
        assert index.leaks(text) == expected


def test_skeleton():
    assert LS.skeleton("Ａb，c —“1,234” é") == LS.skeleton("abc1234é")


def test_leaked(spark):
    docs = spark.createDataFrame([(1, "前缀" + "甲乙丙丁戊己庚辛" + "后缀"), (1, "前缀" + "甲乙丙丁戊己庚辛"), (2, None), (None, "甲乙丙丁戊己庚辛"), (3, "")], "doc_id bigint, text string").selectExpr("*", "5 as item_id", "'x' as query")
    items = spark.createDataFrame([(10, "甲乙丙丁 戊己庚辛！", None), (10, "甲乙丙丁 戊己庚辛！", None), (None, "前缀", None)], "item_id bigint, query string, answer string").selectExpr("*", "1 as doc_id")
    for block in (1, 100):
        assert [tuple(r) for r in LS.leaked(docs, items, block).collect()] == [(1, 10)]
    assert LS.leaked(docs, items.limit(0)).count() == 0 and LS.leaked(docs.limit(0), items).count() == 0


# --- 7: mixture


def test_documents_without_id_count_for_the_budget(spark, tmp_path):
    ranks = tmp_path / "bytes"
    ranks.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    rows = [(None, "x", 1, "abcd"), (None, "y", 2, "ef"), (None, None, 3, "abcd"), (1, "x", 1, "abc"), (1, "y", 2, "abcdef"), (2, "x", 1, None)]
    sized = MX.sized_documents(spark.createDataFrame(rows, "doc_id bigint, source string, fetched_at int, text string"), str(ranks))
    assert {tuple(r) for r in sized.collect()} == {(None, None, 10), (1, "y", 6), (2, "x", 0)}
    assert MX.budget_of(sized) == 16


def test_mixture(spark):
    rng = random.Random(1)
    sources = {"big": 300, "mid": 60, "tiny": 3}
    rows = [(k, s, rng.randint(5, 40)) for k, s in enumerate(s for s, n in sources.items() for _ in range(n))]
    sized = spark.createDataFrame([*rows, (900, None, 50), (None, "big", 5), (901, "big", 0)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("none", 0.0, 1), ("gone", 0.1, None)], "source string, target_share double, max_repeats int").selectExpr("*", "1 as tokens")
    budget = MX.budget_of(sized)
    planned = MX.schedule(sized, targets, ranges=16)
    book = MX.ledger(planned, targets, budget)
    total = {s: sum(t for _, x, t in rows if x == s) for s in sources}
    share = {"big": 0.5, "mid": 0.3, "tiny": 0.2}
    repeats = {"big": 2, "mid": 2, "tiny": 3}
    assert {r.source for r in book.where("short").collect()} == {s for s in sources if total[s] * repeats[s] < share[s] * budget} | {"gone"}
    got = MX.mixture(planned, book, budget).collect()
    # the same by hand: one queue, all copies in order of their finish times
    copies = []
    for s in sources:
        own = sorted((r.through, r.doc_id, r.tokens) for r in planned.where(f"source = '{s}'").collect())
        assert [r[0] for r in own] == list(np.cumsum([r[2] for r in own]))
        copies += [((total[s] * c + through) / share[s], s, d, c + 1, t) for c in range(repeats[s]) for through, d, t in own]
    expected, so_far = [], 0
    for copy in sorted(copies):
        so_far += copy[4]
        if so_far > budget:
            break
        expected.append(copy)
    assert [tuple(r) for r in got] == expected
    report = {r.source: r for r in MX.shares(MX.mixture(planned, book, budget), book).collect()}
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and report["gone"].copies == 0
    empty = MX.schedule(sized.limit(0), targets)
    assert MX.mixture(empty, MX.ledger(empty, targets, 0), 0).count() == 0


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    docs = spark.createDataFrame([(1, "a", "hello world"), (1, "a", "hello world"), (2, "a", None), (3, None, ""), (4, "b", "数" * 50_000)], "doc_id bigint, source string, text string").selectExpr("*", "current_timestamp() as fetched_at", "7 as tokens")
    rows = {r.doc_id: r.tokens for r in MX.sized_documents(docs).collect()}
    assert len(rows) == 4 and rows[1] == len(MX.encoder(MX.TOKENIZER).encode_ordinary("hello world")) and rows[2] == 0 and rows[3] == 0 and rows[4] > 1000
    encode = MX.encoder(MX.TOKENIZER)
    assert encode.decode(encode.encode_ordinary("数据 data é🙂")) == "数据 data é🙂"


# --- 8: cut texts


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows, cut = [], set()
    for k in range(900):
        text = prose(rng.randint(150, 600), rng)
        kind = k % 9
        if kind == 0:
            while text[-1] in "。，\n":
                text = text[: rng.randint(60, len(text) - 2)]
            cut.add(k)
        elif kind == 1:
            text += f"\n{rng.randint(2020, 2024)}年{rng.randint(1, 12)}月{rng.randint(1, 28)}日"
        elif kind == 2:
            text += "\n评级：买入"
        elif kind == 3:
            text += f"\nhttps://a.example.org/{rng.randint(1, 99999)}"
        rows.append((k, "ab"[k % 2], text))
    docs = spark.createDataFrame([*rows, (5, "b", rows[5][2]), (1000, "a", None), (1001, None, "  "), (1002, "a", prose(90_000, rng)), (None, "a", "断")], "doc_id bigint, source string, text string").selectExpr("*", "1 as cut", "2 as size", "3 as tail", "4 as h")
    got = {r.doc_id for r in CD.cut_texts(docs).where("cut").collect()}
    assert len(got & cut) / len(cut) >= 0.88 and len(got - cut) < 0.03 * len(rows) and 1000 not in got and 1001 not in got
    rates = {r.source: r for r in CD.rates(CD.cut_texts(docs)).collect()}
    assert rates["a"].documents == 452
    assert CD.cut_texts(docs.limit(0)).count() == 0


def _ends(spark, rows):
    return CD.endings(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))


def test_limits_stand_out(spark):
    docs = _ends(spark, [(k, "x", "a" * (100 if k % 10 == 0 else 50 + (k * 37) % 400)) for k in range(400)])
    assert CD.length_limits(CD.length_counts(docs)) == {"x": (100,)}
    many = _ends(spark, [(k, "x", "a" * (100 + 200 * (k % 12))) for k in range(600)])
    assert CD.length_limits(CD.length_counts(many)) == {"x": tuple(range(100, 2400, 200))}


def test_nfc_is_in_the_classes():
    assert unicodedata.normalize("NFD", "é") in next(c for c in GU.look_alike_classes() if "é" in c)
