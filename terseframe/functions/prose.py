"""Prose compaction: fillers, verbose phrases, markdown decoration, whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Patterns of fillers, in order; each match is removed. (?d) lets only \n end a line, (?U) makes classes Unicode.
FILLERS = (
    r"(?imdU)^\s*(certainly|absolutely|of course|sure thing|great question|great|excellent|perfect|awesome|no problem|gladly)[,!.]?\s*",
    r"(?imdU)(I(?:'ll| will| can| would be happy to))\s+(?:help you\s+)?(with that|do that|try to|go ahead and|now)\s*",
    r"(?imdU)(let(?:'s| me| us))\s+(now\s+)?(?:take a look|look at|start|begin|walk you through|explain|break this down|dive in|go over)",
    r"(?iU)as an (AI|artificial intelligence) (language model|assistant)[,.]?\s*",
    r"(?iU)it'?s worth (noting|mentioning|pointing out) (that\s*)?",
    r"(?iU)please note (that\s*)?",
    r"(?imdU)^(in summary|to summarize|to summarise|in conclusion)[,:\s]+",
    r"(?imdU)(I hope (this|that) helps?[!.]?|let me know if you (have|need|want)[^.]*\.?|feel free to ask[^.]*\.?)\s*$",
    r"\n{3,}",
)
# Verbose phrases and what stands for them.
PHRASES = {
    "in order to": "to",
    "as well as": "and",
    "due to the fact that": "because",
    "at this point in time": "now",
    "in the event that": "if",
    "is able to": "can",
    "are able to": "can",
    "make use of": "use",
    "the reason why": "why",
    "whether or not": "whether",
    "a number of": "several",
    "on a regular basis": "regularly",
    "in the process of": "while",
    "for the purpose of": "for",
}
# Markdown decoration, in order.
MARKDOWN = ((r"(?mdU)^#{1,6}\s+", ""), (r"\*{2}([^*]+)\*{2}", "$1"), (r"\*([^*]+)\*", "$1"), (r"~~([^~]+)~~", "$1"))


def _chain(text: Column, steps) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def strip_fillers(text: Column) -> Column:
    return _chain(text, ((p, "") for p in FILLERS))


def compact_phrases(text: Column) -> Column:
    return _chain(text, ((rf"(?iU)\b{p}\b", new) for p, new in PHRASES.items()))


def strip_markdown(text: Column) -> Column:
    return _chain(text, MARKDOWN)


def tidy(text: Column) -> Column:
    """Trailing blanks of lines removed, runs of spaces made one, ends stripped."""
    return strip(_chain(text, ((r"(?md)[ \t]+$", ""), (r"  +", " "))))


def minify(text: Column, markdown: bool = False, fillers: bool = True, phrases: bool = True) -> Column:
    if fillers:
        text = strip_fillers(text)
    if phrases:
        text = compact_phrases(text)
    if markdown:
        text = strip_markdown(text)
    return tidy(text)
