"""Ids of whole columns are decoded without a Python number for each id."""

import pyarrow as pa
import public_tokenizers

from graphloom.llm import bpe


def test_columns_of_ids_are_decoded_at_once(monkeypatch):
    made = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["skipped", "", "Ein Satz,  zwei\n", "\u0000 é 漢字 \U0001f600", ""]
    rows = [[int.from_bytes(d[k : k + 4], "little") for k in range(0, len(d), 4)] for d in made.encode_all(texts)]
    odd = pa.array([None, rows[2], [rows[2][0], None], [10**9], [-1], []], pa.list_(pa.int32()))
    assert made.decode_column(odd).to_pylist() == [None, texts[2].encode(), None, None, None, b""]
    monkeypatch.setattr(bpe.Codec, "decode", None)
    column = pa.array(rows, pa.list_(pa.int32()))
    assert made.decode_column(column.slice(1)).to_pylist() == [t.encode() for t in texts[1:]]
    assert made.decode_column(column.slice(4)).to_pylist() == [b""] and made.decode_column(column.slice(5)).to_pylist() == []
