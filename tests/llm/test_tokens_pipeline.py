"""Token ids, SentencePiece and the pipeline against the libraries and plain Python."""

import os
import random
import zlib
from collections import Counter

import helpers as h
import numpy as np
import pytest
import sentencepiece
import zstandard
from test_rules_mix import uniform
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from check import compare, connect
from yieldloom.llm import common, id_coder, pieces_fst, quality, queries
from yieldloom.llm.common import vocabulary

BPE, PIECES = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 200_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for high in (2, 300, 49408):
        ids = rng.integers(0, high, n).astype(np.int32)
        block = id_coder.encode_block(ids, 49408)
        assert (id_coder.decode_block(block) == ids).all()
    skewed = np.minimum(rng.geometric(0.01, n), 49407).astype(np.int32)
    assert n < 200_000 or len(id_coder.encode_block(skewed, 49408)) < 2 * n * 0.6
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        id_coder.decode_block(bytes(broken))


def test_words_are_encoded_as_in_the_whole_text():
    enc, tok = id_coder.WordEncoder(BPE, keep=50), Tokenizer.from_file(BPE)
    texts = ["", "a\x01b", "it's  don't\x0bÉcole <|endoftext|>x ﬁ b", "\x1c\x1d a", "é ́", "ΑΣ ΑΣ. İ", "\x01 x \x01", "日本語 12345!!!??", "w " * 300] + [f"word{i} again" for i in range(200)]
    texts += ["H\u0331 I\u0307 ẖ", "<|ENDOFTEXT|> <|EndOfText|>. X<|endoftext|>.", "It's. don'T, 'S it'.", "é. É, e\u0301! A\u030a.", "a…. …, 5. 55:# b&&& &&& ,.", "ªº. ʰ Ⅷ, ² x²", "AbC abc ABC, abc."]
    for _ in range(2):  # the second time words are remembered, some forgotten
        ids, each = enc.encode([t.encode() for t in texts], 2)
        want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert each.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def check_ids(got, rows):
    tok, at, want = Tokenizer.from_file(BPE), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_id_files(spark):
    df = spark.read.parquet(f"{h.SF}/documents.parquet")
    check_ids(queries.op6_token_ids(spark, h.SF).collect(), [(r.doc_id, r.text) for r in df.collect()])


def test_token_id_edges(spark):
    df = h.edge(spark)
    files = id_coder.write_ids(df, BPE, end=2, block_ids=100)
    check_ids(id_coder.read_ids(files).collect(), [(r.doc_id, r.text) for r in df.collect()])
    again = id_coder.read_ids(files, with_ids=True).collect()
    assert all(crc(r.ids) == r.ids_crc32 for r in again)
    assert id_coder.read_ids(id_coder.write_ids(h.empty(spark), BPE, end=2)).count() == 0


def test_pieces_equal_the_library():
    t, sp = pieces_fst.Transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rnd = random.Random(1)
    alphabet = "aaab eee  tth ▁ \n\té日本x12 .,inǵ\U0001f600"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    texts += ["a" * 500, " " * 100, "indivisibilities" * 20, "the " * 50, "\x00", "<0x0A> <s> </s> <unk>"]
    for x in texts:
        assert t.encode(x) == sp.encode(x), x
        assert t.decode(t.encode(x)) == sp.decode(sp.encode(x)), x


def test_sentencepiece_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = h.edge(spark).select("doc_id", "text").union(spark.read.parquet(f"{h.SF}/documents.parquet").select("doc_id", "text"))
    got = pieces_fst.encode_pieces(df, PIECES).collect()
    want = Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in df.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.round_trip for r in got if r.doc_id != 6) and all(r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids) for r in got)
    assert pieces_fst.encode_pieces(h.empty(spark), PIECES).count() == 0


def test_sentencepiece_query_returns_ids(spark):
    got = queries.op8_sentencepiece(spark, h.SF).collect()
    assert got and all(r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids) for r in got)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    err, _ = compare(queries.queries()[name](spark, h.SF), queries.oracle_sql()[name], connect(h.SF))
    assert err is None, err


def plain_pipeline(rows, labels):
    """rows of (doc_id, text, source) -> what the five stages keep, as a count of (doc_id, crc of its ids)."""
    z = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    rows = [r for r in rows if quality.judge((r[1] or "").encode(), z, quality.BANDS, quality.CHUNK, 0.5)[6]]
    best = {}
    for r in rows:
        t = h.lower(r[1])
        if t not in best or best[t][0] < r[0]:
            best[t] = r
    rows = list(best.values())
    first = {c for _, n, c in h.jaccard_components([r[:2] for r in rows]) if n}
    rows = [r for r in rows if r[0] in first]
    weight = {1: 2.0, 0: 0.5}
    sized = [(d, s, len(h.words(t)), weight.get(labels.get(d), 1.0)) for d, t, s in rows]
    sp, text = sentencepiece.SentencePieceProcessor(model_file=PIECES), {d: t for d, t, _ in rows}
    out = Counter()
    for d, n, _, taken in h.mix(sized, uniform)[1]:
        if taken:
            out[d, crc(sp.encode(text[d]))] += -(-taken // n)
    return out


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, h.SF)
    labels = {}
    for r in spark.read.parquet(f"{h.SF}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{h.SF}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.ids_crc32) for r in got.collect()) == plain_pipeline(rows, labels)


def test_stages_on_odd_rows(spark, tmp_path):
    good = " ".join(f"word{i % 97}x{i}" for i in range(200))
    odd = h.edge(spark).drop("size")
    more = spark.createDataFrame([(50 + i, good + f" tail{i // 2}", None, "s", None) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.unionByName(more, allowMissingColumns=True)
    cols = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, h.SF)
        assert out.columns == cols
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.schema(out.schema).parquet(str(tmp_path / str(k)))
    got = corpus_pipeline.STAGES[-1][1](spark, docs, h.SF).collect()
    assert all(r.round_trip for r in got) and [r.doc_id for r in got] == [51, 51]  # one text left, one source, a share of 1.5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, h.empty(spark), h.SF).count() == 0


def test_near_stage_joins_at_four_fifths_of_five_words(spark):
    text = " ".join(f"a{i}" for i in range(200))
    more = text + " " + " ".join(f"b{i}" for i in range(40))  # 196 of 236 shingles of five words, 197 of 237 of four
    less = text + " " + " ".join(f"c{i}" for i in range(60))  # 196 of 256
    docs = spark.createDataFrame([(1, text), (2, more), (3, less)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, h.SF).collect()) == [1, 3]


def test_registered_once_for_each_operator():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_a_pipeline_leaves_the_tables_of_others(spark):
    held = id_coder.write_ids(spark.read.parquet(f"{h.SF}/documents.parquet"), BPE, end=2)
    before = held.count()
    with common.staging_for("pipeline"):
        own = common.stage(spark.range(3).toDF("n"), "own")
    common.release(spark, "pipeline")
    assert held.count() == before and not os.path.exists(own._staged_at.removeprefix("file:"))
    common.unstage(held)


def test_other_models_than_bpe_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="BPE"):
        pieces_fst.Transducer(str(tmp_path / "other.model"))
