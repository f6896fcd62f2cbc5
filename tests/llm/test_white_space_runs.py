import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilframe.llm import tokens


@pytest.mark.parametrize("text", ["a" + " " * 1_500_000 + "b", "\n" * 1_500_000, "x!" + "\n" * 1_500_000 + "y", "a" + " \n" * 750_000 + "<|endoftext|> b" + "\u3000" * 150_000 + "c"])
def test_long_white_space_runs(text):
    enc = tokens.encoder(tokens.default_path())
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert enc(text).tolist() == want and enc.width[enc(text)].sum() == len(text.encode())
