"""What an encoder remembers of a chunk serves the same word in another chunk."""

import public_tokenizers

from textloom.llm.bpe_codec import Codec
from textloom.llm.wordbpe import vocab


def test_a_word_is_encoded_once():
    c = Codec(vocab(public_tokenizers.path("word_bpe_49k.json")))
    alone = c.encode_bytes("quorvéx")
    made, plain = [], c._word
    c._word = lambda w: made.append(w) or plain(w)
    c.words.make = c._word
    assert c.encode_bytes("quorvéx,").startswith(alone)
    assert made == [","]
