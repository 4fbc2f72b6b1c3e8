"""Every code point is split as the two libraries split it."""

from __future__ import annotations

import base64

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from fixturelab.llm import bpe, token_counts


def every_text():
    """Each code point between letters, after a number and after a space; blocks keep the calls few."""
    characters = bpe.every_character()
    return [" ".join(f"a{x}b7{x}" for x in characters[low : low + 64]) for low in range(0, len(characters), 64)]


def test_ids_of_every_code_point_are_those_of_tiktoken():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(bpe.load_ranks(path), public_tokenizers.PATTERN, bpe.tiktoken_departures())
    texts = every_text()
    wanted = library.encode_ordinary_batch(texts)
    for text, ids in zip(texts, wanted):
        found = own.encode(text)
        assert found == b"".join(x.to_bytes(4, "little") for x in ids), [hex(ord(x)) for x in text if not x.isascii()][:1]
        assert own.decode(found) == text.encode()


def test_counts_of_every_code_point_are_those_of_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    own = token_counts.Counter(open(path, encoding="utf-8").read(), public_tokenizers.PATTERN, None, token_counts.tokenizers_departures())
    texts = every_text()
    wanted = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.count(x) for x in texts] == wanted


def test_departures_are_given_as_sets():
    def members(name):
        own = set(regex.findall(name, bpe.every_character()))
        return "".join(own - {"é"} | {"‽"} if name == bpe.CLASSES[0] else own)

    found = bpe.departures(members)
    assert [x[0] for x in found] == [bpe.CLASSES[0]]
    split = bpe.Splitter(public_tokenizers.PATTERN, found).find
    assert split("ab‽c é7 àé!") == ["ab‽c", " é", "7", " à", "é!"]
    assert bpe.Splitter(public_tokenizers.PATTERN).find("ab‽c é7") == ["ab", "‽", "c", " é", "7"]
