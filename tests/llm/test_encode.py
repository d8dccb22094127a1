import random

import pytest

from tessaro.llm.encode import StreamDecoder, Transducer, Vocabulary, decode, encode, transducer, vocabulary_file

tokenizers = pytest.importorskip("tokenizers")
FOLDER = "/opt/tokenizers"


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def machine():
    return transducer(vocabulary_file("byte_bpe_50k", FOLDER))


def texts():
    rng = random.Random(3)
    every = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    yield from ("", " ", "\n\n  x", "<|endoftext|>", "don't we'll I'd", "a" * 3000, "=" * 700, "  \t leading", "日本語と中文", "é̂", "👩‍👩‍👧‍👦", "x\x00y�")
    for _ in range(60):
        yield "".join(rng.choices(every, k=120))
        yield "".join(rng.choices(" \n\t\r\x0b\x1c\x85\xa0abcABC019'st<|>!?_-=", k=200))
        yield "".join(rng.choices("aeiounrstlm", k=300))


def test_ids_equal_the_library(library, machine):
    for text in texts():
        assert machine.text(text) == library(text), ascii(text[:60])


def test_decoding_in_pieces_gives_the_text(machine):
    for text in texts():
        ids, d = machine.text(text), StreamDecoder(machine.vocabulary)
        assert "".join(d.feed([i]) for i in ids) + d.close() == text


def test_a_small_vocabulary_by_definition():
    rng = random.Random(1)
    merges = [b"ab", b"ba", b"aba", b"abab", b"bb", b"abb", b"aa", b"baab"]
    import base64

    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([bytes([c]) for c in range(256)] + merges))
    machine = Transducer(Vocabulary(lines))
    for _ in range(500):
        word = "".join(rng.choices("abc", k=rng.randrange(1, 30)))
        assert [machine.vocabulary.token[i] for i in machine.word(word.encode())] == machine.vocabulary.merge(word.encode())


def test_table(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "Wörter, 12.5%\n" * 20_000, "d"), (4, "again", "e"), (None, "x", "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    lines = vocabulary_file("byte_bpe_50k", FOLDER)
    got = encode(df, lines)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == sorted((i or 0, library(t) if t else []) for i, t, _ in rows)
    assert sorted(r.text for r in decode(got, lines).collect()) == sorted(t or "" for _, t, _ in rows)
    assert encode(df.limit(0), lines).count() == 0
