"""Token based operators: packing and token files."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_tables import ODD, nothing, odd, prose  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusforge.llm import packing, wavelet
from corpusforge.llm.arrays import text_bytes
from corpusforge.llm.tokens import TextEncoder

FILES = {"word_bpe_49k.json": 2, "byte_bpe_50k.json": 0}
HARD = ["", None, " a", "a  b", "a   b c", "x \n y", "\n", " ", "don't  stop", "a b c", "<|endoftext|> hi", "é ́x  '  's", "a\t b", "tail ", "a.\nB, c's. x.,y",
        "A.\n", "\nA", "ab\n\ncd", "x y z", "ÀÉ İstanbul ΣΑΣ ok,.", "1,234.5 a.b", "a'll.x 'll", "…,a ..a,,b", "\x1c\x1d a\x85b", "a　 b", "Ǆ ǅ"]


def ids_of(file, text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [FILES[file]]


@pytest.mark.parametrize("file", FILES)
def test_encoder_equals_the_tokenizer(file):
    texts = HARD + [t for _, t in ODD]
    encoder = TextEncoder(public_tokenizers.path(file), FILES[file])
    for _ in range(2):
        ids, offsets = encoder.encode(*text_bytes(pa.array(texts, pa.string())))
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == ids_of(file, text), text


def check_packed(rows, expected, limits):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["length"] > 0 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for members in sequences.values():
        members.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in members] == [0, *np.cumsum([r["length"] for r in members])[:-1]]
        assert sum(r["length"] for r in members) <= limits.tokens
        assert len(members) <= limits.segments and sum(r["loss_tokens"] for r in members) <= limits.loss
    got = sorted((d is None, d or 0, tuple(i for s, ids in sorted((r["start"], r["ids"]) for r in own) for i in ids)) for (d, _), own in pieces.items())
    assert got == sorted(set((d is None, d or 0, tuple(ids)) for d, ids in expected))
    return sequences


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64), packing.Limits(50, 8, 20), packing.Limits(1, 1, 1)])
def test_packing_keeps_every_id(spark, limits):
    rows = [r for r in ODD if r[0] not in (6, None)] if limits.tokens == 1 else [r for r in ODD if r[0] is not None]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    packed = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), 2, limits, with_ids=True)
    check_packed(packed.collect(), [(d, ids_of("word_bpe_49k.json", t)) for d, t in rows], limits)


def test_packing_odd_rows(odd, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path, 2).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of("word_bpe_49k.json", t)) for _, t in ODD)
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert packing.pack_documents(nothing, path, 2).collect() == []


def test_packing_pads_little(spark):
    rows = [(i, prose(i, 20 + i % 300)) for i in range(600)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    used, sequences = sum(r["length"] for r in packed), len({r["sequence_id"] for r in packed})
    assert sequences == -(-used // 4096)


def test_prompt_tokens_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "tell me more about it please", "yes"), (2, "a", None), (3, None, "fine words")], "doc_id long, ask string, text string")
    limits = packing.Limits(64, 2, 4)
    rows = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), 2, limits, with_ids=True, prompt="ask").collect()
    assert sum(r["loss_tokens"] for r in rows if r["doc_id"] == 1) == 2
    check_packed(rows, [(1, ids_of("word_bpe_49k.json", "tell me more about it please")[:-1] + ids_of("word_bpe_49k.json", "yes")), (2, ids_of("word_bpe_49k.json", "a")[:-1] + [2]), (3, ids_of("word_bpe_49k.json", "fine words"))], limits)


def test_limits_are_checked(odd):
    with pytest.raises(ValueError):
        packing.pack_documents(odd, "", 2, packing.Limits(0))


@pytest.mark.parametrize("n,most", [(0, 1), (1, 1), (1000, 7), (5000, 50_257), (70, 1 << 20)])
def test_wavelet_matrix(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.uint32)
    matrix = wavelet.WaveletMatrix.of(ids)
    assert matrix.all().tolist() == ids.tolist()
    for at in range(0, n, max(1, n // 50)):
        assert matrix.access(at) == ids[at]
    for token in [*set(ids[:20].tolist()), most + 1, 1 << 25]:
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places)
        assert matrix.count(token, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
        assert [matrix.locate(token, k) for k in range(len(places))] == places.tolist()
        assert matrix.locate(token, len(places)) == -1


@pytest.mark.parametrize("shard", [40, 1 << 20])
def test_token_files_round_trip(spark, odd, tmp_path, shard):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = wavelet.write_tokens(odd, str(tmp_path / "t"), path, 0, shard).collect()
    shards.sort(key=lambda s: (s["part"], s["shard"]))
    before = wavelet.token_index([(s["file"], s["tokens"]) for s in shards])
    got = sorted((before[r["file"]] + r["place"], r["doc_id"], list(r["ids"])) for r in wavelet.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect())
    want, start = [], 0
    for d, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = ids_of("byte_bpe_50k.json", t)
        want.append((start, d, ids))
        start += len(ids)
    assert got == want
    crc = {r["place"] + before[r["file"]]: r["ids_crc32"] for r in wavelet.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert crc == {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for s, _, ids in want}


def test_token_files_of_nothing(nothing, tmp_path):
    assert wavelet.write_tokens(nothing, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), 0).collect() == []


def test_places_of_shards_equal_the_index(spark):
    from corpusforge.llm import wavelet

    rows = [(part, shard, f"{part}-{shard}", 1, 3 * part + shard + 1) for part in (0, 2, 11) for shard in range(part % 3 + 2)]
    shards = spark.createDataFrame(rows, "part long, shard long, file string, docs long, tokens long").repartition(4)
    got = {r["file"]: r["before"] for r in wavelet.token_places(shards).collect()}
    assert got == wavelet.token_index([(r[2], r[4]) for r in rows])
    assert wavelet.token_places(shards.limit(0)).collect() == []
