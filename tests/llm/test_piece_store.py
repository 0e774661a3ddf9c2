"""The store of pieces: ids stay those of the library when it starts anew, and no stored piece is merged again."""

from public_tokenizers import path

from trendloom.llm.tokens import Encoder

VOCABULARY = path("byte_bpe_50k.json")
TEXTS = ["One two, three two one!", " 12 x1 ' a's _b \t c  d", "é été  ÿ £5 ab3c", "two two", "\x1bx \x00y 'll"]


def ids(data: bytes) -> list[int]:
    return [int.from_bytes(data[at : at + 4], "little") for at in range(0, len(data), 4)]


def test_a_small_store_gives_the_ids_of_the_library():
    small, large = Encoder(VOCABULARY, kept=3), Encoder(VOCABULARY, kept=1000)
    for text in TEXTS * 2:
        expected = small.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids(small.encode(text)) == expected
        assert ids(large.encode(text)) == expected


def test_each_piece_is_merged_once_while_the_store_has_room():
    merged = []

    class Counting(Encoder):
        def _piece(self, piece):
            merged.append(piece)
            return super()._piece(piece)

    encoder = Counting(VOCABULARY, kept=200_000)
    words = [f"a{n}" for n in range(130_000)]  # letters and digits are pieces of their own
    encoder.encode(" ".join(words))
    encoder.encode(" ".join(words))
    assert len(merged) == len(set(merged)) > 120_000
