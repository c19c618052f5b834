import os
import zlib

import corpora
import numpy as np
import pytest
from tokenizers import Tokenizer

from fitweave.llm import tokens
from fitweave.llm.seekable import Reader, Writer


def model(text):
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


ODD = ["it's we'll!'s x'Sb <|endoftext|> a<|startoftext|>B", "<|ENDOFTEXT|> up", "éá. Å = ̸≮", "Σίσυφος ΣΑΣ", "12ab34!!,,##", "a b c​d\x85e\x1cf", "İI ſK"]


def test_ids_equal_whole_text_encoding(spark, tmp_path):
    rows = corpora.texts() + ODD
    df = corpora.documents(spark, rows)
    got = tokens.read_tokens(tokens.write_tokens(df, str(tmp_path / "out"))).collect()
    got = sorted(got, key=lambda r: r.doc_id)
    start = 0
    for i, (row, text) in enumerate(zip(got, rows)):
        ids = model(text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (100 + i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for row in got[:: 5]:
        assert Reader(row.file).document(row.doc_id).tolist() == model(rows[row.doc_id - 100]).tolist()


def test_only_wanted_frames_are_read(tmp_path):
    path = f"file://{tmp_path}/x.tokens"
    writer = Writer(path, frame_ids=100)
    docs = {i: np.arange(i, i + 40 + i, dtype=np.uint32) for i in range(50)}
    docs[50] = np.arange(700_000, dtype=np.uint32)
    docs[51] = np.zeros(0, dtype=np.uint32)
    for i, ids in docs.items():
        writer.add(i, ids)
    writer.close()
    reader = Reader(path)
    assert reader.document(7).tolist() == docs[7].tolist() and reader.frames_read <= 2
    assert all(reader.document(i).tolist() == ids.tolist() for i, ids in docs.items())
    with pytest.raises(KeyError):
        reader.document(99)


def test_damage_is_found_and_stays_in_its_frame(tmp_path):
    path = tmp_path / "x.tokens"
    writer = Writer(f"file://{path}", frame_ids=100)
    for i in range(20):
        writer.add(i, np.arange(200, dtype=np.uint32) * i)
    writer.close()
    data = bytearray(path.read_bytes())
    data[Reader(f"file://{path}").places[3] + 20] ^= 255
    path.write_bytes(bytes(data))
    reader = Reader(f"file://{path}")
    with pytest.raises(Exception):
        reader.document(3)
    assert Reader(f"file://{path}").document(4).tolist() == (np.arange(200) * 4).tolist()


def test_defined_results(spark, tmp_path):
    awkward = corpora.awkward(spark)
    got = tokens.read_tokens(tokens.write_tokens(awkward, str(tmp_path / "a"))).orderBy("start").collect()
    assert len(got) == awkward.count()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert sorted(r.n_tokens for r in got) == sorted(len(model(r.text)) for r in awkward.collect())
    assert tokens.read_tokens(tokens.write_tokens(corpora.empty(spark), str(tmp_path / "b"))).collect() == []
    assert not any(name.endswith(".tmp") for name in os.listdir(tmp_path / "a"))
