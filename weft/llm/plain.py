"""Text as it is meant, however spelled."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other alphabets that look like Latin ones; fixed values.
ALIKE = str.maketrans("аеорсухіѕјһԁɡαοεινκтмвнкАЕОРСУХІЅЈТМВНК", "aeopcyxisjhdgaoeivktmbhkAEOPCYXISJTMBHK")
#: Digits and signs written for letters; fixed values.
LEET = str.maketrans("@431!0$57", "aaeiiosst")


def folded(s: str) -> str:
    """Without accents, look-alike letters and invisible characters, in lower case."""
    s = unicodedata.normalize("NFKD", s)
    if not s.isascii():
        s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        if re.search(r"[A-Za-z]", s):
            s = " ".join(w.translate(ALIKE) if re.search(r"[A-Za-z]", w) or len(w) < 3 else w for w in s.split(" "))
    return s.lower()


def unleet(w: str) -> str:
    return w.translate(LEET) if re.search(r"[a-z]", w) and re.search(r"[@$!0-9]", w.strip("!")) else w


def plain(s: str) -> str:
    """folded, and leet, stretched and spaced spellings undone."""
    s = re.sub(r"\b(?:\w ){3,}\w\b", lambda m: m[0].replace(" ", ""), folded(s))
    s = re.sub(r"\b(?:\w[.\-_*]){2,}\w\b", lambda m: re.sub(r"[.\-_*]", "", m[0]), s)
    s = re.sub(r"([a-z])\1{2,}", r"\1", s)
    return re.sub(r"[\w@$!*]+", lambda m: unleet(m[0]), s)
