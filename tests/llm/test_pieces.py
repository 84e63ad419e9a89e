"""Pieces that are merged for themselves have the ids that the library gives the whole text."""

import random

import public_tokenizers
import pyarrow as pa

from vellumspark.llm import lexicon_bpe

CONFIG = lexicon_bpe.read_config(public_tokenizers.path("word_bpe_49k.json"))
BITS = ["a", "B", "É", "é", "ß", "İ", "ı", "K", "ſ", "Σ", "ς", "́", "e", "'s", "'S", "'", "'LL", ".", ",", "!", ";", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "\x0b", "\x1c", "\x85", " ", " ", "1", "23", "漢字", "😀", "Word", "-", "\x00", "\x7f", "Å", "Å", "ﬁ", "µ", "×"]


def test_pieces_have_the_ids_of_the_library():
    tokenizer, chance = lexicon_bpe.quiet(CONFIG), random.Random(1)
    texts = ["".join(chance.choice(BITS) for _ in range(chance.randint(0, 30))) for _ in range(3000)]
    encoder = lexicon_bpe.Encoder(lexicon_bpe.quiet(CONFIG), None)
    ids, at = encoder.texts(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_case_and_stops_make_no_new_words():
    encoder = lexicon_bpe.Encoder(lexicon_bpe.quiet(CONFIG), None)
    encoder.texts(pa.array(["Reonier reonier, REONIER. reonier! Reonier"]))
    assert sorted(encoder.known) == ["!", ",", ".", "reonier"]


def test_words_of_letters_are_merged_by_the_model():
    """Words of ASCII letters, after a space or not, pass no pre-tokenizer and have the library's ids."""
    import public_tokenizers
    import pyarrow as pa

    from vellumspark.llm.repair_grammar import PieceEncoder

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        e = PieceEncoder(f.read())
    pieces = ["Word", " word", " Zqxjv", "zqxjvwk", " a", "a", " ", "  b", " don't", "don't", " é", "naïve", " x1", "x1", " .", "A" * 300, " " + "bc" * 200]
    met = []
    library, joined = e.library, e.joined
    e.library, e.joined = (lambda t: (met.extend(t), library(t))[1]), (lambda p: (met.extend(p.to_pylist()), joined(p))[1])
    ids, at = e.pieces(pa.array(pieces))
    assert not {"Word", " word", " Zqxjv", "zqxjvwk", " a", "A" * 300} & set(met)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]
