"""Words and word fingerprints of texts, as small helpers for functions that run inside tasks."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

_INVISIBLE = re.compile("[­​-‏ -‮⁠﻿]")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]{0,200})?/?>|<br\s*/?>")
_NOT_WORD = re.compile(r"[^\w\s]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def clean(text: str) -> str:
    """Text without markup tags, entities and invisible characters; compatibility forms unified."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "&" in text:
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", html.unescape(text)))
    if "<" in text:
        text = _TAG.sub(" ", text)
    return text


def words(text: str | None) -> list[str]:
    """Words as white space separates them, lower case, letters and digits only."""
    if not text:
        return []
    return _NOT_WORD.sub("", clean(text).lower()).split()


def word_codes(tokens: list[str], cache: dict[str, int]) -> np.ndarray:
    codes = []
    for w in tokens:
        c = cache.get(w)
        if c is None:
            c = cache[w] = xxhash.xxh3_64_intdigest(w)
        codes.append(c)
    return np.array(codes, dtype=np.uint64)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h = h * _BASE + codes[j : j + n]
            h ^= h >> np.uint64(29)
        h *= _MIX
        return h ^ (h >> np.uint64(32))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash in every window; spans of k + window - 1 equal words share one."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n <= window:
        return np.array([int(hashes.argmin())])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))
