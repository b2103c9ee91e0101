"""Words as TESTDATA.md defines them: longest runs of letters and digits, lower-cased."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; null gives none."""
    return WORD.findall(text.lower()) if text else []
