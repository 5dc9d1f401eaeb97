"""Collocations, repeated strings and token alignment against brute force and on edge cases."""

import collections
import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from assayer.llm import alignment, collocations, doubling, queries, transducers
from assayer.llm.common import prepare
from assayer.llm.registry import CHECKS, QUERIES

SMALL = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
NAMES = "doc_id long, text string, lang string, rid string, n string, low string, pair string, key string, a string"


def frame(spark, rows):
    return prepare(spark).createDataFrame([(i, t, lang, *["x"] * 6) for i, t, lang in rows], NAMES)


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()


def collocations_in_sql(rows, least):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.execute(CHECKS["op11_transducer_collocations"].replace("f >= 30", f"f >= {least}")).fetchall())


def test_collocations_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    expected = sorted(con.execute(CHECKS["op11_transducer_collocations"]).fetchall())
    assert sorted(map(tuple, QUERIES["op11_transducer_collocations"](spark, SMALL).collect())) == expected


def test_collocations_of_odd_texts(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "A", "bé", "c\x01", "c", "c\x00d", "\x02"]
    rows = [(k, " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\t", "!\n"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for k in range(80)]
    rows += [(None, None, "en"), (1, "", None), (1, "a a a a a a a a", "en"), (2, "... ;; ..", "xx"), (3, "only", "zz")]
    expected = collocations_in_sql([r for r in rows if "\x00" not in (r[1] or "")], 3)
    for ranges in (64, 1):
        monkeypatch.setattr(collocations, "RANGE_BLOCKS", ranges)
        got = collocations.collocations(frame(spark, [r for r in rows if "\x00" not in (r[1] or "")]), 3).collect()
        assert sorted(map(tuple, got)) == expected
    assert collocations.collocations(frame(spark, rows), 3).count() > 0
    assert collocations.collocations(frame(spark, []), 3).count() == 0


def test_transducers_keep_counts_and_compose():
    rng = random.Random(1)
    counts = {tuple(rng.choice([b"x", b"y", b"zz"]) for _ in range(rng.randrange(1, 5))): rng.randrange(1, 1 << 40) for _ in range(90)}
    made = transducers.Transducer(transducers.build(sorted(counts.items())))
    assert list(made.items()) == sorted(counts.items())
    asked = {p: 0 for p in list(counts)[::3]} | {(b"q",): 0, (b"x", b"q"): 0}
    found = dict(transducers.compose(transducers.Transducer(transducers.build(sorted(asked.items()))), made))
    assert found == {p: counts[p] for p in asked if p in counts}
    same = transducers.Transducer(transducers.build([((a, b), 5 + k) for k, a in enumerate([b"a", b"b", b"c"]) for b in (b"1", b"2")]))
    assert len(same.arcs) == 3  # equal continuations are one node once their common count is pushed ahead


def removed_by_hand(docs, threshold):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = collections.Counter(r[i : i + threshold] for _d, r in raws for i in range(len(r) - threshold + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - threshold + 1):
            if seen[r[i : i + threshold]] > 1:
                gone[i : i + threshold] = b"\x01" * threshold
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_of_the_documents(spark):
    got = QUERIES["op12_prefix_doubling"](spark, SMALL).collect()
    assert sorted(map(tuple, got), key=str) == removed_by_hand(documents(), 400)


@pytest.mark.parametrize("threshold, stretch", [(40, 1 << 20), (40, 64), (17, 500)])
def test_repeats_of_edited_copies(spark, threshold, stretch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcd ") for _ in range(2000))
    docs = []
    for k in range(60):
        at = rng.randrange(1500)
        text = list(base[at : at + rng.randrange(400)] + "".join(rng.choice("abcd ") for _ in range(rng.randrange(60))) + base[: rng.randrange(300)])
        for _ in range(rng.randrange(4)):
            if text:
                text[rng.randrange(len(text))] = "é"
        docs.append((k, "".join(text)))
    docs += [(1, "a" * 700), (501, "ab" * 300), (None, None), (503, ""), (504, "a" * (threshold + 1)), (505, "x" * (threshold - 1)), (506, base), (506, base)]
    got = doubling.remove_repeats(frame(spark, [(d, t, "en") for d, t in docs]), threshold, stretch).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == removed_by_hand(docs, threshold)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert doubling.remove_repeats(frame(spark, []), threshold).count() == 0


def aligned_by_hand(docs):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    counts, rows = collections.Counter(), []
    for d, text in docs:
        raw = (" " + text).encode() if text else b""
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        spelled = [bytes(letters[c] for c in first.id_to_token(i)) for i in a], [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if any(b"".join(s) != raw for s in spelled):
            a, b = [], []
        links, groups, own = [], [], ([], [])
        i = j = at = until = 0
        for k, token in enumerate(a):
            until += len(spelled[0][k])
            own[0].append(token)
            while j < len(b):
                links.append((token, b[j]))
                end = at + len(spelled[1][j])
                if end > until:
                    break
                own[1].append(b[j])
                at, j = end, j + 1
                if end == until:
                    break
            if at == until:
                groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
                own = ([], [])
        counts.update(links)
        text = ";".join(groups)
        rows.append((d, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    best = {}
    for (_a, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return sorted(((d, na, nb, ng, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), h) for d, na, nb, ng, ls, h in rows), key=str)


def test_alignment_of_the_documents(spark):
    assert sorted(map(tuple, QUERIES["op13_arrow_alignment"](spark, SMALL).collect()), key=str) == aligned_by_hand(documents())


def test_alignment_of_odd_texts(spark):
    docs = [(1, None), (2, ""), (None, "plain text"), (3, "<|endoftext|> and </s> <s> <unk>"), (4, "\u2581 is a space to one side"), (5, "été 日本語 🙂 \x00\t\r\n  x"), (6, " "), (7, "a" * 3000), (7, "plain text"), (8, "ﬁne ½")]
    expected = aligned_by_hand(docs)
    for bound in (1 << 20, 0):
        got = alignment.align(frame(spark, [(d, t, "en") for d, t in docs]), queries.BYTE_BPE["ranks_path"], queries.BYTE_BPE["pattern"], PIECES, bound)
        assert sorted(map(tuple, got.collect()), key=str) == expected
    assert alignment.align(frame(spark, []), queries.BYTE_BPE["ranks_path"], queries.BYTE_BPE["pattern"], PIECES).count() == 0
