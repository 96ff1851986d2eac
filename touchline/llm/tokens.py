"""Token ids and pre-tokens of the public byte-level vocabulary inside tasks.

The vocabulary comes as a rank file of the same merges as the tokenizer's JSON file; both
give the same ids, and the rank file's library (tiktoken) is the faster one. Its pattern fails on blank runs
of about a million characters, so long runs are left to the JSON file's library (tokenizers).
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken

#: Fixed value: the vocabulary's only added token, recognised inside texts, and its id.
END_OF_TEXT = "<|endoftext|>"
END_ID = 50256

#: Characters on whose class (letter, number, space) the pattern library and the tokenizer agree.
_PLAIN = regex.compile(r"[\x00-՗‐-⁞₠-₿ぁ-ゖァ-ヺ一-鿌]*")


#: Blanks in a row that are not given to the rank file's library, which takes several times as many.
LONG_RUN = 100_000
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Tried at the beginning of a run only: a run that is too short is not scanned again from each of its blanks.
_LONG_BLANKS = regex.compile(f"(?<!{_BLANK}){_BLANK}{{{LONG_RUN},}}+")


def rank_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def json_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary, loaded once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


def _blank_ids(blanks: str, path: str) -> list[int]:
    """Ids of one pre-token of blanks. ``path`` is the rank file; the JSON file lies beside it."""
    return _tokenizer(path.removesuffix(".tiktoken") + ".json").encode(blanks, add_special_tokens=False).ids


def _part_ids(part: str, path: str) -> np.ndarray:
    """Ids of a text without the added token; each long blank run is cut out as the pre-token it is."""
    found, at = [], 0
    encode = encoder(path).encode_to_numpy
    for run in _LONG_BLANKS.finditer(part) if len(part) >= LONG_RUN else ():
        end = run.end() if run.end() == len(part) else run.end() - 1  # the last blank goes with what follows
        if run.start() > at:
            found.append(encode(part[at : run.start()], disallowed_special=()))
        found.append(np.array(_blank_ids(part[run.start() : end], path), "<u4"))
        at = end
    if at < len(part):
        found.append(encode(part[at:], disallowed_special=()))
    return np.concatenate(found) if found else np.empty(0, "<u4")


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of the whole text as little-endian unsigned 32-bit integers."""
    parts = [_part_ids(part, path) for part in text.split(END_OF_TEXT)]
    for i in range(len(parts) - 1, 0, -1):
        parts.insert(i, np.array([END_ID], "<u4"))
    return np.concatenate(parts).astype("<u4", copy=False)


def pre_tokens(text: str, path: str) -> list[str]:
    """Pre-tokens in order, the added token among them. ``path`` is the JSON file."""
    if _PLAIN.fullmatch(text) and END_OF_TEXT not in text:
        return _pattern().findall(text)
    found: list[str] = []
    split = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    for i, part in enumerate(text.split(END_OF_TEXT)):
        if i:
            found.append(END_OF_TEXT)
        if _PLAIN.fullmatch(part):
            found += _pattern().findall(part)
        else:
            found += [part[a:b] for _, (a, b) in split(part)]
    return found


def piece_count(pre_token: str, path: str) -> int:
    """Pieces of one pre-token. ``path`` is the rank file."""
    if len(pre_token) >= LONG_RUN and _LONG_BLANKS.fullmatch(pre_token):
        return len(_blank_ids(pre_token, path))
    return 1 if pre_token == END_OF_TEXT else len(encoder(path).encode_ordinary(pre_token))
