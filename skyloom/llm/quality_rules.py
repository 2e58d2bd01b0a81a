"""Quality rules: line-first cleaning.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines are removed, and a
document that loses too large a share of its text is rejected. The text is read once, row by row, in
Arrow batches; nothing is shuffled, so a hot source or a group of copies costs no more than other rows.

Edge cases: a null or empty text has no words, fails the base rules and is rejected with an empty
cleaned text. Repeated rows get equal verdicts. Very long texts are processed whole; memory is bounded
by one text's words. An empty table gives an empty result. Only the id and text columns are read, so
other columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, slices

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds. The base ones are part of the result contract; the line ones are the method's own."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: A line fails the punctuation rule when symbol characters exceed this share of its word characters
    #: and more than this share of its words has one.
    max_symbol_share: float = 0.10
    max_symbol_words: float = 0.5
    #: ... or when at least this share of its words ends in exclamation marks and it has enough words.
    max_shout_share: float = 0.5
    #: A line fails the navigation rule with this many separators and at most so many words a separator.
    min_separators: int = 3
    max_words_per_separator: float = 4.0
    #: A line of at least so many letters fails the capitals rule beyond this share.
    min_capital_letters: int = 12
    max_capital_share: float = 0.7
    #: A line fails the boilerplate rule when it has a stock phrase and at most so many words.
    max_boilerplate_words: int = 25
    #: ... or when more than this share of its words repeats the word before.
    max_stutter_share: float = 0.4
    #: A document is rejected when the removed lines hold more than this share of its word characters.
    max_removed_share: float = 0.30


#: Stock phrases of page furniture, matched without case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here to subscribe",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "use of cookies",
)
_STOCK = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
#: Single-character words that part entries of a menu.
SEPARATORS = frozenset("|»›•·>/")


def line_verdict(line: str, words: list[str], rules: Rules) -> str:
    """The first rule that a line fails, or an empty string. A line without words passes: it carries no text."""
    if not words:
        return ""
    n, chars = len(words), sum(map(len, words))
    separators = sum(w in SEPARATORS for w in words)
    if separators >= rules.min_separators and n <= rules.max_words_per_separator * separators:
        return "navigation"
    if n >= 2 and len(_SYMBOLS.findall(line)) > rules.max_symbol_share * chars and sum(_SYMBOLS.search(w) is not None for w in words) > rules.max_symbol_words * n:
        return "punctuation"
    if n >= 4 and sum(w.endswith(("!!", "??", "!?")) for w in words) > rules.max_shout_share * n:
        return "punctuation"
    if n >= 4:
        letters = sum(map(len, _LETTERS.findall(line)))
        if letters >= rules.min_capital_letters and sum(map(len, _UPPER.findall(line))) > rules.max_capital_share * letters:
            return "navigation"
    if n <= rules.max_boilerplate_words and _STOCK.search(line):
        return "boilerplate"
    if n >= 8 and sum(map(str.__eq__, words, words[1:])) > rules.max_stutter_share * n:
        return "boilerplate"
    return ""


def repeat_words(words: list[str], size: int) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : n + i] for i in range(size))))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = reached = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + size - max(i, reached)
            reached = i + size
    return covered


def assess(text: str | None, rules: Rules) -> dict:
    """All figures, the verdict and the cleaned text of one document."""
    text = text or ""
    lines = text.split("\n")
    by_line = [_WORDS.findall(line) for line in lines]
    words = [w for ws in by_line for w in ws]
    chars = sum(map(len, words))
    seen: set[str] = set()
    dup = 0
    verdicts: dict[str, str] = {}
    kept_lines, removed = [], 0
    for line, ws in zip(lines, by_line, strict=True):
        if ws:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
                verdicts[line] = line_verdict(line, ws, rules)
            if verdicts[line]:
                removed += sum(map(len, ws))
                continue
        kept_lines.append(line)
    repeated = repeat_words(words, rules.window)
    failed = len(words) < rules.min_words or 100 * repeated > rules.max_repeat_percent * len(words)
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": len(_SYMBOLS.findall(text)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
        "base_failed": failed,
        "removed_chars": removed,
        "kept": not failed and removed <= rules.max_removed_share * chars,
        "clean_text": "\n".join(kept_lines),
    }


FIGURES = {
    "n_words": ("long", pa.int64()),
    "word_chars": ("long", pa.int64()),
    "n_symbols": ("long", pa.int64()),
    "n_dup_lines": ("long", pa.int64()),
    "n_repeat_words": ("long", pa.int64()),
    "base_failed": ("boolean", pa.bool_()),
    "removed_chars": ("long", pa.int64()),
    "kept": ("boolean", pa.bool_()),
    "clean_text": ("string", pa.large_string()),
}


def clean_documents(
    docs: DataFrame,
    rules: Rules = Rules(),
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    figures: tuple[str, ...] = tuple(FIGURES),
) -> DataFrame:
    """The ``keep`` columns and the asked ``figures`` of every document, the line-cleaned text among them."""
    source = docs.select(*keep, *([text] if text not in keep else []))
    kept_fields = [f for f in source.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields] + [f"{k} {FIGURES[k][0]}" for k in figures])
    at = [source.columns.index(f.name) for f in kept_fields]
    text_at = source.columns.index(text)

    def run(batches):
        for batch in slices(batches):
            found = [assess(t, rules) for t in batch.column(text_at).to_pylist()]
            arrays = [batch.column(i) for i in at]
            arrays += [pa.array([x[k] for x in found], FIGURES[k][1] if k != "clean_text" else pa.string()) for k in figures]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept_fields] + list(figures))

    return source.mapInArrow(run, schema)
