"""Pre-tokens of the byte-level vocabularies."""

from __future__ import annotations

import regex

#: Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

find_pretokens = regex.compile(PATTERN).findall
