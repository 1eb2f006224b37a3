"""Compiled patterns by their text: looked up in a plain dict, for hot loops."""

from __future__ import annotations

import regex

_KNOWN: dict = {}


def compiled(pattern: str, flags: int = 0):
    p = _KNOWN.get((pattern, flags))
    if p is None:
        p = _KNOWN[(pattern, flags)] = regex.compile(pattern, flags)
    return p


def match(pattern: str, text: str, flags: int = 0):
    return compiled(pattern, flags).match(text)


def search(pattern: str, text: str, flags: int = 0):
    return compiled(pattern, flags).search(text)


def fullmatch(pattern: str, text: str, flags: int = 0):
    return compiled(pattern, flags).fullmatch(text)


def finditer(pattern: str, text: str):
    return compiled(pattern).finditer(text)


def split(pattern: str, text: str):
    return compiled(pattern).split(text)


def sub(pattern: str, to: str, text: str):
    return compiled(pattern).sub(to, text)
