"""Shorter and clearer prompts: compression, rewriting and building.

Compression works on what lies between protected zones (code, inline code, URLs, paths), which stay as they are. The phrase tables
are parameters with small defaults. Null stays null; empty and blank texts give ''; compressing twice changes nothing more.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import features

PROTECTED = re.compile(r"(```[\s\S]*?(?:```|$)|`[^`\n]+`|https?://\S+|(?<![\w/])(?:[\w.~-]*/)+[\w.-]+|\b[\w-]+\.(?:py|ts|tsx|js|jsx|go|rs|java|rb|cpp|sql|kt|ya?ml|json|toml|md|sh)\b)")
# Characters with a plain form.
PLAIN = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", " ": " ", "​": "", "‌": "", "‍": "", "﻿": "", "­": ""})
#: Wordy phrases and what replaces them; longest first.
PHRASES: dict[str, str] = {
    "due to the fact that": "because", "in order to": "to", "at this point in time": "now", "in the event that": "if", "for the purpose of": "for", "with regard to": "about", "a large number of": "many", "is able to": "can",
    "has the ability to": "can", "make use of": "use", "take into account": "consider", "as well as": "and", "i would like you to": "", "i was wondering if you could": "", "could you please": "", "can you please": "", "please note that": "", "it would be great if you could": "",
    "麻烦你帮我": "", "能不能帮我": "", "请帮我": "", "我想要": "", "进行修改": "修改", "进行分析": "分析",
}
#: Words that add nothing.
FILLERS: tuple[str, ...] = ("basically", "actually", "really", "very", "just", "simply", "kind of", "sort of", "kindly", "please", "其实", "就是说", "那个")
HEDGES = re.compile(r"\b(?:i think|i guess|maybe|perhaps|possibly|somehow|if possible)\b,?\s*", re.I)
_THANKS = re.compile(r"(?:^|(?<=[.!?\n]))\s*(?:many )?(?:thanks|thank you|thx)[\w\s,]*[.!]*\s*$", re.I)


def _rules(phrases: Mapping[str, str], fillers: tuple[str, ...]) -> re.Pattern[str]:
    words = sorted([*phrases, *fillers], key=len, reverse=True)
    word = lambda w: rf"\b{re.escape(w)}\b" if w.isascii() else re.escape(w)
    return re.compile("|".join(word(w) for w in words), re.I)


_DEFAULT_RULES = _rules(PHRASES, FILLERS)


def _tidy(t: str) -> str:
    for pattern, by in ((r"[ \t]+(?=\n)", ""), (r"\n{3,}", "\n\n"), (r"(?<=\S)[ \t]{2,}", " "), (r"\*{2,3}([^*\n]+)\*{2,3}", r"\1"), (r"(?m)^[-=]{3,}$", ""), (r"[ \t]+([,;.!?])", r"\1"), (r",(?:\s*,)+", ","), (r"\.{4,}", "..."), (r"，{2,}", "，"), (r"。{2,}", "。")):
        t = re.sub(pattern, by, t)
    return t


def compress_text(text: str | None, safe: bool = False, phrases: Mapping[str, str] = PHRASES, fillers: tuple[str, ...] = FILLERS) -> str | None:
    """The text with plain characters, shorter phrases and no fillers; safe: only characters, white space and punctuation."""
    if text is None:
        return None
    rules = _DEFAULT_RULES if phrases is PHRASES and fillers is FILLERS else _rules(phrases, fillers)
    # Few rounds settle any text; the bound only guards against rules of a caller that undo each other.
    for _ in range(50):
        out = []
        for i, part in enumerate(PROTECTED.split(text)):
            if i % 2 == 0:
                part = unicodedata.normalize("NFKC", part.translate(PLAIN))
                if not safe:
                    part = rules.sub(lambda m: phrases.get(m[0].lower(), ""), part)
                part = _tidy(part)
            out.append(part)
        new = "".join(out)
        if not safe:
            new = _THANKS.sub("", new)
        new = re.sub(r"^[\s,;.]+", "", new).strip()
        if new == text:
            return new
        if text[:1].isupper() and new[:1].islower() and not PROTECTED.match(new):
            new = new[0].upper() + new[1:]
        if new == text:
            return new
        text = new
    return text


def saved(before: Column, after: Column) -> Column:
    """Share of white-space words that compression saved, between 0 and 1."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.when(words(before) > 0, F.round(1 - words(after) / words(before), 4)).otherwise(0.0)


@F.pandas_udf(T.StringType())
def compress(text: pd.Series) -> pd.Series:
    return text.map(compress_text, na_action="ignore")


def rewrite_text(text: str | None) -> str | None:
    """Compressed, without hedges, the first instruction in front if it began after three tenths of the prompt."""
    if text is None or not text.strip():
        return text
    short = compress_text(text) or ""
    parts = PROTECTED.split(short)
    short = "".join(p if i % 2 else HEDGES.sub("", p) for i, p in enumerate(parts)).strip()
    found = features.segment_text(short)
    lead = next((i for i, s in enumerate(found) if s[1] == "instruction"), None)
    if lead and found[lead][2] > 0.3:
        found.insert(0, found.pop(lead))
        short = "\n\n".join(s[0].strip("\n") for s in found)
    return short


@F.pandas_udf(T.StringType())
def rewrite(text: pd.Series) -> pd.Series:
    return text.map(rewrite_text, na_action="ignore")


# The order of the parts of a prompt.
PARTS = ("role", "task", "files", "error", "context", "examples", "constraints", "output_format")


def build(parts: Mapping[str, Column], style: str = "markdown") -> Column:
    """A prompt of the parts that are not blank, in the order of PARTS: as markdown sections, XML elements or plain paragraphs."""
    pieces = []
    for name in PARTS:
        if name in parts:
            c = F.trim(parts[name])
            title = name.replace("_", " ").capitalize()
            shown = F.concat(F.lit(f"<{name}>\n"), c, F.lit(f"\n</{name}>")) if style == "xml" else F.concat(F.lit(f"## {title}\n"), c) if style == "markdown" else c
            pieces.append(F.when(F.length(c) > 0, shown))
    return F.concat_ws("\n\n", *pieces)
