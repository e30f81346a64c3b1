"""The whole-text check of the SentencePiece operator, run without Spark so that faults can be put into the codec."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from weft.llm import sentencepiece_codec
from weft.llm.queries import tokenizer_path


def test_sentencepiece_holds_every_text_against_library(monkeypatch):
    """A fault in any one text, in its ids or its decoding, fails the job; equal texts give equal rows."""

    class Docs:
        schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    run = sentencepiece_codec.encode_documents(Docs(), tokenizer_path())
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    plain, spaced = ["one two", "é 😀.", "a" * 60_000], ["one  two", "three  four", " five", "six ", "▁ seven", "a  \ue000"]
    out = next(run(iter([batch([*plain, *spaced, *plain])]))).to_pylist()
    assert [{**r, "doc_id": 0} for r in out[:3]] == [{**r, "doc_id": 0} for r in out[-3:]]
    for own, texts in (("encode", spaced), ("decode_raw", plain + spaced)):
        with monkeypatch.context() as m:
            real = getattr(sentencepiece_codec.Codec, own)
            m.setattr(sentencepiece_codec.Codec, own, lambda self, x, real=real: real(self, x)[:-4])
            for text in texts:
                with pytest.raises(AssertionError, match="differs from the sentencepiece library"):
                    list(run(iter([batch([text])])))
