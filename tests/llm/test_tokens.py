import random

from semloom.llm import tokens


def texts():
    rng = random.Random(5)
    bits = ["été", " ", "  ", "\n", "\t \n", "don't", "'re", "123", "<|endoftext|>", "<|endo", "ftext|>", "漢字かな", "!!", " ", " ", "\x1c", "word", "Ünï", ".", ",", "***", "\n", "end.\nNew", "a<|endoftext|>.\nb", "ſ.", "x|", "\n\nz", "|>", "🙂", "a b"]
    return ["", " ", "   ", "x", *("".join(rng.choice(bits) for _ in range(rng.choice([3, 30, 300, 3000]))) for _ in range(120)), "a" * 5000, " " * 5000, "ab " * 3000 + "字" * 3000]


def test_units_and_encoder_match_the_library():
    tokenizer, encode = tokens.load(), tokens.Encoder(room=50_000)
    for text in texts():
        whole = tokenizer.encode(text, add_special_tokens=False).ids
        assert "".join(tokens.units(text)) == text
        assert list(memoryview(encode(text)).cast("I")) == whole


def test_counts_with_small_chunks(spark):
    tokenizer, rows = tokens.load(), list(enumerate(texts())) + [(900, None), (None, "a b"), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(2)
    got = tokens.token_counts(df, whole=150, chunk=300, overlap=120).collect()
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_long_units_are_not_kept():
    rng = random.Random(6)
    encode, tokenizer = tokens.Encoder(room=5_000), tokens.load()
    for k in range(40):
        text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000)) + f" word{k} and more"
        assert list(memoryview(encode(text)).cast("I")) == tokenizer.encode(text, add_special_tokens=False).ids
    assert 0 < sum(150 + 4 * len(u) + len(ids) for u, ids in encode.seen.items()) <= 5_500 and all(len(u) <= tokens.KEPT_LENGTH for u in encode.seen)


def test_word_hashes_keep_short_words_only():
    import xxhash

    from semloom.llm.common import WordHashes

    words = [b"a", b"b" * 64, b"c" * 65, b"d" * 100_000, b"a"] * 3 + [f"w{k}".encode() for k in range(90)]
    hashes = WordHashes(limit=10)
    assert [*hashes(words)] == [xxhash.xxh3_64_intdigest(w) for w in words] == [*hashes(words)]
    hashes(words[:5])
    assert set(hashes.seen) == {b"a", b"b" * 64}
