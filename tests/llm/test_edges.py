"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assayer.llm import chat, common, contamination, factors, grace, histosort, mincut, mixture, noisyor, ordermin, pitmanyor
from assayer.llm.common import prepare
from assayer.llm.queries import BYTE_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, digest string, h string, word string, size string, body string, n string, score string"
PROSE = "The first part says one thing. The second part says another thing, at some length, and ends here."
LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
TEXTS = [(1, PROSE), (2, PROSE + " "), (3, None), (4, ""), (None, PROSE), (None, None), (5, "!!! ???"), (6, LONG), (7, "One."), (8, "é È ü"), (1, PROSE), (9, "a\tb\r\nc  d")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i == 7 else "s1", None, *["x"] * 8) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(prepare(spark), TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(prepare(spark), [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("b1", "says one thing. The second part says another thing at some"), ("b2", None), (None, "ONE"), ("b3", "")], "item_id string, text string")


def test_exact_duplicates(odd, none):
    rows = grace.exact_duplicates(odd).collect()
    assert len(rows) == len(TEXTS) and grace.exact_duplicates(none).count() == 0
    prose = [r for r in rows if r["text_sha256"] == hashlib.sha256(PROSE.replace(" ", "").encode()).hexdigest()]
    assert len(prose) == 4 and {r["keep_id"] for r in prose} == {2} and {r["group_size"] for r in prose} == {4}
    empty = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 3 and {r["keep_id"] for r in empty} == {3}
    groups = {r["text_sha256"] for r in rows}
    assert sum(r["kept"] for r in rows) == len(groups)
    kept = grace.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_repeated_rows_keep_one(spark):
    twice = frame(spark, [(1, "same"), (1, "same"), (None, "other"), (None, "other")])
    assert grace.drop_exact_duplicates(twice).count() == 2
    assert ordermin.drop_near_duplicates(twice).count() == 2


def test_overflow_goes_to_further_levels(odd):
    wide = sorted(map(tuple, grace.exact_duplicates(odd).drop("rid").collect()), key=str)
    narrow = sorted(map(tuple, grace.exact_duplicates(odd, table_bytes=1).drop("rid").collect()), key=str)
    assert wide == narrow


def test_writes_grow_with_the_logarithm(spark, monkeypatch):
    """As many buckets as tables are needed; a fan-out below that makes spill files of buckets first."""
    docs = frame(prepare(spark), [(k, f"text number {k // 2} " * 9) for k in range(800)])
    writes = []
    monkeypatch.setattr(grace, "settle", lambda df, by=None, kept=grace.settle: (writes.append(by), kept(df, by))[1])
    rows = docs.select(F.encode("text", "UTF-8").alias("raw"), F.lit(1).cast("long").alias("n_chars"), "doc_id")
    found = []
    for table_bytes, fan_out in ((1 << 20, 4096), (50_000, 4096), (12_500, 4096), (50_000, 4)):
        writes.clear()
        groups = grace.groups_of_equal(rows, table_bytes, fan_out)
        found.append(sorted(map(tuple, groups.drop("ties").collect())))
        assert len(found[-1]) == 400 and {r[1] for r in found[-1]} == {2}
        assert writes[0] == ("bucket" if fan_out == 4 else None) and (fan_out == 4 or len(writes) <= 3)
    assert all(f == found[0] for f in found)


def test_hits_without_a_broadcast(odd, benchmark, monkeypatch):
    """Beyond the broadcast bound tokens move with their reach only; the result is the same."""
    near = sorted(map(str, contamination.contamination(odd, benchmark).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert near == sorted(map(str, contamination.contamination(odd, benchmark).collect())) and any("contaminated=True" in r for r in near)


def test_near_duplicates(odd, none):
    rows = {(r["doc_id"], r["rid"]): r for r in ordermin.near_duplicates(odd).collect()}
    assert len(rows) == len(TEXTS) and ordermin.near_duplicates(none).count() == 0
    by_id = {}
    for (doc_id, _), r in rows.items():
        by_id.setdefault(doc_id, set()).add((r["class_id"], r["class_size"]))
    assert by_id[1] == by_id[2] == {(1, 4)} and by_id[3] == by_id[4] == {(3, 3)} and by_id[5] == {(5, 1)} and by_id[6] == {(6, 1)}
    kept = ordermin.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["class_id"] for r in rows.values()})


def test_contamination(odd, none, benchmark, spark):
    rows = contamination.contamination(odd, benchmark).collect()
    assert len(rows) == len(TEXTS) and contamination.contamination(none, benchmark).count() == 0
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["contaminated"] and by_id[1]["n_hit"] in (10, 11)
    assert by_id[3]["n_words"] == 0 and not by_id[4]["contaminated"] and by_id[5]["n_words"] == 0 and by_id[6]["n_words"] == 30_000
    assert by_id[7]["n_hit"] == 1 and by_id[7]["items_sha256"] == hashlib.sha256(b"").hexdigest() and by_id[7]["n_items"] == 1
    no_items = benchmark.filter("false")
    assert not any(r["contaminated"] for r in contamination.contamination(odd, no_items).collect())
    clean = contamination.drop_contaminated(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == sum(not r["contaminated"] for r in rows)


def test_shards(odd, none):
    rows = histosort.shard(odd, 4).collect()
    assert len(rows) == len(TEXTS) and histosort.shard(none, 4).count() == 0
    for k in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {16}


def test_hot_text_is_split(spark):
    rows = histosort.shard(frame(spark, [(k, "copy " * 20) for k in range(60)] + [(100 + k, f"text {k}") for k in range(40)]), 8).collect()
    total = sum(r["size"] for r in rows)
    sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(8)]
    assert max(sizes) - total / 8 <= 120 and total / 8 - min(sizes) <= 120


def test_several_ranges_in_a_shard(odd):
    rows = histosort.shard(odd.unionByName(odd).unionByName(odd), 2, range_rows=5).collect()
    for k in (0, 1):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


def test_packing(odd, none):
    rows = mixture.pack(odd, **BYTE_BPE).collect()
    assert mixture.pack(none, **BYTE_BPE).count() == 0
    assert sum(r["length"] for r in rows if r["doc_id"] in (3, 4)) == 2
    for k in {r["sequence_id"] for r in rows}:
        place = 0
        for r in sorted((r for r in rows if r["sequence_id"] == k), key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place == 2048 or k == max(r["sequence_id"] for r in rows)


def test_toxicity(odd, none, labels):
    rows = noisyor.toxicity(odd, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows) and noisyor.toxicity(none, labels).count() == 0
    assert all(r["score"] < 0.3 for r in noisyor.toxicity(odd, labels.filter("false")).collect())
    assert noisyor.drop_toxic(odd, labels.filter("false")).columns == odd.columns


def test_quality(odd, none, labels):
    rows = factors.quality(odd, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows) and factors.quality(none, labels).count() == 0
    assert factors.quality(odd.select("doc_id", "text"), labels.filter("false")).count() == len(TEXTS)


def test_language_model(odd, none):
    rows = pitmanyor.score_documents(odd).collect()
    assert len(rows) == len(TEXTS) and pitmanyor.score_documents(none).count() == 0
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["n_tokens"] == by_id[4]["n_tokens"] == 1 and by_id[6]["n_tokens"] == 30_001 and by_id[None]["held_out"]
    assert all(r["score"] < 0 for r in rows)
    held_only = pitmanyor.score_documents(odd.filter("doc_id IS NULL")).collect()
    assert {r["n_known"] for r in held_only} == {0} and {r["train_tokens"] for r in held_only} == {0}


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (3, "u", "<p>An <b>open page. It never ends", "x"), (4, "u", "<script>", "x"), (5, "u", "plain " * 50_000, "x")], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in mincut.extract(pages).collect()}
    assert rows[1]["text"] == rows[None]["text"] == rows[4]["text"] == "" and rows[3]["text"] == "An open page. It never ends"
    assert rows[5]["n_chars"] == len(rows[5]["text"]) == 299_999
    assert mincut.extract(pages.filter("false")).count() == 0


def test_chats(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (1, None, "tool", "[ROLE] \\ </s>"), (1, 1, "assistant", "b"), (2, 0, "assistant", "<|endoftext|>")],
        "conv_id long, turn long, role string, text string",
    ).withColumn("ids", F.lit("clash"))
    rows = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns, **BYTE_BPE), **BYTE_BPE).collect()}
    assert rows[1]["n_turns"] == 4 and rows[1]["loss_chars"] == 2
    assert rows[1]["turns_sha256"] == hashlib.sha256(b"tool\n[ROLE] \\ </s>\nuser\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert rows[None]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest() and rows[2]["loss_sha256"] == hashlib.sha256(b"<|endoftext|>").hexdigest()
    assert chat.read_chats(chat.format_chats(turns.filter("false"), **BYTE_BPE), **BYTE_BPE).count() == 0


def test_names_of_the_callers_columns(spark, labels, benchmark):
    docs = spark.createDataFrame([(1, PROSE, 5, "a", "b", "c"), (2, PROSE, 6, "a", "b", "c")], "doc_id long, text string, __row int, __id string, __H string, __toxicity string")
    for found in (grace.drop_exact_duplicates(docs), ordermin.drop_near_duplicates(docs), contamination.drop_contaminated(docs, benchmark.limit(0)), noisyor.drop_toxic(docs, labels)):
        assert found.columns == docs.columns
        assert set(map(tuple, found.collect())) <= set(map(tuple, docs.collect()))
    assert ordermin.drop_near_duplicates(docs).count() == 1
    assert grace.drop_exact_duplicates(docs).count() == 1
