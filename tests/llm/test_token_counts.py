import random

import public_tokenizers
import sentencepiece

from fleetloom.llm import token_counts

from .helpers import corpus, frame, result

MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def wanted(rows):
    return sorted(((i, len((t or "").encode()), len(MODEL.encode(t or ""))) for i, t in rows), key=repr)


def test_whole_and_spliced_counts_are_the_librarys(spark):
    rows = corpus()
    draw = random.Random(1)
    alphabet = ["the", "é", "<s>", "</s>", "▁x", "ﬁ", "  ", "\n", "naïve", "日本語", "a1", "🙂", "zz zz", "　"]
    rows += [(100 + i, " ".join(draw.choice(alphabet) for _ in range(900))) for i in range(4)]
    rows += [(200, "q" * 3000), (201, "no.spaces," * 400), (200, "q" * 3000), (202, "ab cd " * 700)]
    got = token_counts.count_tokens(frame(spark, rows), chunk_chars=200, overlap_chars=40)
    assert result(got, "doc_id", "n_bytes", "n_tokens") == wanted(rows)
    assert result(token_counts.count_tokens(frame(spark, rows)), "doc_id", "n_bytes", "n_tokens") == wanted(rows)


def test_the_splice_is_used(spark):
    text = "some words are here 7 times and more " * 40
    parts = token_counts.cut(text, 200, 40)
    assert len(parts) > 5
    assert sum(token_counts.count_span(MODEL, *part) for part in parts) == len(MODEL.encode(text))
    assert token_counts.cut("x" * 500, 200, 40) is None
    assert token_counts.stable_spaces(MODEL)


def test_empty(spark):
    assert token_counts.count_tokens(frame(spark, [])).count() == 0
