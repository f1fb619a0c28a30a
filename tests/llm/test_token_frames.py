import io
import os
import zlib

import numpy as np
import pytest

from rosterlake.llm import token_frames
from rosterlake.llm.models import public_file

from .rows import LONG, awkward, clashing, empty

TOKENIZER = public_file("byte_bpe_50k.json")
ODD = [
    "a  b\n\n c'll don't ½²x",
    "\x1c\x85 q 漢字 word",
    "<|endoftext|> hi there",
    " " * 9 + "x\t\t y  ",
    "É à l'été 12ab_c--d\xa0 e",
    " lead",
    "trail \n",
    "a\r\nb \n c\n\n\nd",
    "tab\tinside run\x0b x",
    "it's we'll THEY'RE 1st",
    "\n",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("text", [*ODD, LONG[:5000], "plain words. Then\nmore, of them"])
def test_encoder_equals_library(library, text):
    own = token_frames.Encoder(TOKENIZER)
    for _ in range(2):  # from scratch and from memory
        ids = np.frombuffer(own.encode(text), "<u2").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids + [0]


def test_encoder_forgets_when_full(library, monkeypatch):
    monkeypatch.setattr(token_frames, "MEMORY", 3)
    own = token_frames.Encoder(TOKENIZER)
    for text in ("one two three four", "five six one two", "seven\neight nine"):
        assert np.frombuffer(own.encode(text), "<u2").tolist() == library.encode(text).ids + [0]


def test_files_read_back_in_order(spark, tmp_path, library):
    docs = clashing(awkward(spark))
    files = token_frames.write_tokens(docs, str(tmp_path / "t"), TOKENIZER)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    assert sum(r["n_docs"] for r in files.collect()) == len(rows)
    got = token_frames.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    at = 0
    for r, want in zip(got, rows, strict=True):
        ids = library.encode(want["text"] or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["tokens"]) == (want["doc_id"], at, ids)
        at += len(ids)
    digests = token_frames.read_digests(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [d["ids_crc32"] for d in digests] == [zlib.crc32(np.array(r["tokens"], "<u4").tobytes()) for r in got]
    wanted = spark.createDataFrame([(6,), (8,), (77,)], "doc_id long")
    found = token_frames.look_up(spark, str(tmp_path / "t"), wanted).collect()
    assert sorted(r["doc_id"] for r in found) == [6, 8, 8]


def test_empty_table(spark, tmp_path):
    assert token_frames.write_tokens(empty(spark), str(tmp_path / "t"), TOKENIZER).count() == 0
    assert token_frames.read_digests(spark, str(tmp_path / "t")).count() == 0


class Opened(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_damage_is_found(tmp_path):
    path = tmp_path / "f"
    with open(path, "wb") as file:
        writer = token_frames.FrameWriter(file, 2)
        for k in range(3):
            writer.add(k, np.arange(50 + k, dtype="<u2").tobytes())
        writer.close()
    data = bytearray(path.read_bytes())
    assert token_frames.FrameReader(Opened(data)).tokens(2).tolist() == list(range(52))
    data[20] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017  zstandard's error or the checksum's
        token_frames.FrameReader(Opened(data)).tokens(0)
    assert token_frames.FrameReader(Opened(data)).tokens(1).tolist() == list(range(51))


def test_frames_are_plain_zstandard(tmp_path):
    import zstandard

    path = tmp_path / "f"
    with open(path, "wb") as file:
        writer = token_frames.FrameWriter(file, 2)
        writer.add(1, b"ab" * 30)
        writer.add(None, b"cd")
        writer.close()
    with zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True) as stream:
        assert stream.read() == b"ab" * 30 + b"cd"
    assert os.path.getsize(path) > 0
