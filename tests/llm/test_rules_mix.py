"""Quality rules, source mixing and chat formatting."""

import base64
import hashlib
import random

import helpers as h
import pytest
from pyspark.sql import functions as F

from yieldloom.llm import chat, mixing, queries, quality


def test_base_counts(spark):
    df = h.edge(spark).select("doc_id", "text", "size").union(spark.read.parquet(f"{h.SF}/documents.parquet").select("doc_id", "text", F.lit("x")))
    want = sorted(((r.doc_id, *h.base_quality(r.text)) for r in df.collect()), key=str)
    got = quality.quality_rules(df).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.quality_rules(h.empty(spark)).count() == 0


def test_bands_reject_noise_and_repeats_and_keep_prose(spark):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(800)]
    prose = " ".join(rnd.choice(vocab) for _ in range(900))
    noise = " ".join(base64.b64encode(rnd.randbytes(30)).decode() for _ in range(200))
    turns = [f"{i} {w}" for i, w in enumerate(vocab[:30])]
    period = " ".join(" ".join(rnd.sample(turns, 30)) for _ in range(60))  # no repeated 3-word windows to speak of, yet the same 30 pieces
    mixed = prose[:2000] + " ".join(f"{a}{a}{a}{a}{a}{a}{a}{a}{a}{a} {b}" for b in range(30) for a in range(40))
    df = spark.createDataFrame([(1, prose), (2, noise), (3, mixed), (4, period)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert got[1].kept and not got[1].reason
    assert got[2].reason == "incompressible" and not got[2].kept and not got[2].base_failed
    assert got[3].reason == "repetitive" and not got[3].kept
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, r in got.items() if r.kept}


def test_rows_keep_their_columns(spark):
    df = h.edge(spark)
    assert quality.keep_good(df).schema == df.schema


def uniform(d, seed=20):
    return (int(hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


@pytest.mark.parametrize("cells", [1, 4096])
def test_mixing(spark, cells):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["s1", "s10", "s2", None, "big", "big", "big"]), rnd.randrange(0, 300), rnd.choice([0.5, 1.0, 2.0])) for i in range(300)]
    rows += [(5, "s1", 7, 1.0), (None, "big", 3, 1.0), (900, "nothing", 0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, w double")
    target, want = h.mix(rows, uniform)
    got = mixing.mix_sources(df, weight="w", cells=cells).collect()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * (1 + target[r.source])
    assert sorted(((r.doc_id, r["size"], r.source, r.taken) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.taken <= 2 * r["size"] and r.copies * r["size"] >= r.taken for r in got)


def test_mixing_edges(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    df = h.edge(spark).select("doc_id", "source", mixing.n_words("text").alias("size"), F.struct("*").alias("doc"))
    got = mixing.mix_sources(df).collect()
    assert len(got) == df.count() and {r["size"] for r in got} == {len(h.words(r.doc.text)) for r in got}


def test_chat_round_trips():
    rnd = random.Random(6)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/", "s>", "INST]", " ", "a", "é", "\n"]
    for _ in range(4000):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "a[/ROLE]b"]), "".join(rnd.choice(bits) for _ in range(rnd.randrange(9)))) for _ in range(rnd.randrange(4))]
        text = "".join(chat.format_turn(r, t) for r, t in turns)
        back = chat.parse(text)
        assert [x[:2] for x in back] == turns
        assert all(chat.unescape(text[a:b]) == t for (_, t, a, b) in back)
    assert chat.format_turn("user", "plain [x] <b>") == "[INST]plain [x] <b>[/INST]"
    assert chat.parse("[INST]a") is None and chat.parse("x<s>a</s>") is None and chat.parse("") == []


def test_chat_digests(spark):
    got = {r.conv_id: r for r in queries.op4_chat_format(spark, h.SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{h.SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for c in got:
        turns = sorted(r[1:] for r in rows if r[0] == c)
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.format_turn(r, t or "")) for _, r, t in turns)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, chars string"
    rows = [(1, 0, None, None, None, None), (1, 0, None, None, None, None), (None, None, "user", "x" * 100000, None, None), (2, 1, "assistant", "b", None, None), (2, 0, "assistant", "a", None, None)]
    got = {r.conv_id: r for r in chat.digest_chats(chat.read_chats(chat.format_chats(spark.createDataFrame(rows, schema)))).collect()}
    assert got[1].n_turns == 2 and got[None].n_turns == 1 and got[2].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert chat.digest_chats(chat.read_chats(chat.format_chats(spark.createDataFrame([], schema)))).count() == 0


def test_every_byte_lies_in_a_judged_chunk():
    import random

    import zstandard

    rnd, seen = random.Random(4), []
    z = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)

    class Watch:
        def compress(self, raw):
            seen.append(raw)
            return z.compress(raw)

    clean = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(2000)).encode()
    for n in (0, 1, 4095, 4096, 4097, 6000, 6143, 6144, 8191, 9000, 11_000):
        seen.clear()
        quality.verdict(clean[:n], Watch(), quality.BANDS, quality.CHUNK, 0.5)
        assert b"".join(seen[1:] or seen) == clean[:n] and all(len(x) <= quality.CHUNK for x in seen[1:])
    tails = [quality.verdict(clean[:4096] + b"x" * n, z, quality.BANDS, quality.CHUNK, 0.5)[3] for n in (0, 1990, 2100)]
    assert tails == ["", "repetitive", "repetitive"]
