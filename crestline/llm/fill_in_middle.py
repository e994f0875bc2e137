"""Fill-in-middle transformation by an event scan.

A document is a sequence of units, and its two cuts lie between units.  Which characters share a
unit follows from their class: a run of one class is dealt into units of a fixed number of
characters, or is one unit.  One Aho-Corasick automaton finds what matters in a text: the
ASCII characters that change the class, and the sentinels, whose presence keeps a text whole.
Between two events the class stands still, so a gap yields its number of units by arithmetic, and the
place of the r-th unit is looked up in the running sums over the gaps: no list of units is ever made.
Where all classes deal alike (code points) no character changes anything, the sentinels are the
only events, and a text is one gap.

The scan returns three numbers a text; cutting, output and restoring are column expressions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)


@dataclass(frozen=True)
class Units:
    """How characters make units: ``other`` for any that ``classes`` does not list.

    A class maps its ASCII characters to the number of characters a unit takes of a run of them; 0 takes
    the whole run.
    """

    other: int = 1
    classes: Mapping[str, int] = field(default_factory=dict)

    def changing(self) -> dict[str, tuple[int, int]]:
        """Character to (class number, size) for those that are not dealt like all others.

        Characters dealt one by one form the same units wherever a run of them ends, so among
        them classes need not be told apart.
        """
        if not all(c.isascii() for chars in self.classes for c in chars):
            raise ValueError("only ASCII characters change the class")
        found = {}
        for n, (chars, size) in enumerate(self.classes.items(), 1):
            if not (size == 1 and self.other == 1):
                found |= dict.fromkeys(chars, (0 if size == 1 else n, size))
        return found


#: Every code point is a unit.
CODE_POINTS = Units()
#: A stretch of blanks is a unit, and so is one of other characters; a line break stands alone.
WORDS = Units(0, {" \t": 0, "\n": 1})
#: Words as above, digits in groups of three.
DIGIT_GROUPS = Units(0, {" \t": 0, "\n": 1, "0123456789": 3})


class EventScan:
    """Scans texts for the events of ``units`` and for sentinels."""

    def __init__(self, units: Units = CODE_POINTS, sentinels: tuple[str, ...] = SENTINELS):
        import ahocorasick

        self.other = units.other
        self.automaton = ahocorasick.Automaton()
        for c, told in units.changing().items():
            self.automaton.add_word(c, told)
        for s in sentinels:
            self.automaton.add_word(s, (-1, 0))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[bool, list[int], list[int], list[int]]:
        """Whether a sentinel occurs, and the gaps: first character, units before, size of a unit.

        The last entry of the first two lists is the end of the text and the number of units.
        """
        marked, starts, before, sizes = False, [0], [0], []
        # A run lies open from ``starts[-1]``: class 0 stands for every character that is not an event.
        kind, size, end = 0, self.other, 0

        def close(at: int) -> None:
            run = at - starts[-1]
            if run:
                sizes.append(size)
                before.append(before[-1] + (-(-run // size) if size else 1))
                starts.append(at)

        for at, (new, new_size) in self.automaton.iter(text):
            if new < 0:
                marked = True
                continue
            if at > end and (kind, size) != (0, self.other):  # plain characters since the last event
                close(end)
                kind, size = 0, self.other
            if (new, new_size) != (kind, size):
                close(at)
                kind, size = new, new_size
            end = at + 1
        if len(text) > end and (kind, size) != (0, self.other):
            close(end)
            kind, size = 0, self.other
        close(len(text))
        return marked, starts, before, sizes

    @staticmethod
    def place(rank: int, starts: list[int], before: list[int], sizes: list[int]) -> int:
        """The character at which unit ``rank`` begins (the number of units: the end of the text)."""
        gap = bisect_right(before, rank) - 1
        return starts[gap] + (rank - before[gap]) * sizes[gap] if gap < len(sizes) else starts[-1]

    def cuts(self, text: str, h1: int, h2: int) -> tuple[int, bool, int, int]:
        """Number of units, whether a sentinel occurs, and the characters before the two cuts."""
        marked, *gaps = self.scan(text)
        n = gaps[1][-1]
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, marked, self.place(first, *gaps), self.place(second, *gaps)


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four 32-bit integers for an id, the first groups of a SHA-256 (null id: of the empty string)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, units: Units = CODE_POINTS, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs`` (``doc_id``, ``text``).

    ``n`` counts units.  ``rate`` percent of the documents are cut, ``spm_rate`` percent of these with the
    suffix first.  A document stays ``plain`` if it is empty, holds a sentinel or is not drawn; it then
    has null lengths.  The draws depend on ``seed`` and ``doc_id`` alone, so repeated ids are drawn alike, a null
    id as the empty string.  A null text counts as empty.  Other columns are ignored; a row gives a row.
    """

    def scanned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scan = EventScan(units)
        for texts, h1, h2 in batches:
            yield pd.DataFrame([scan.cuts(*row) for row in zip(texts, h1, h2, strict=True)], columns=["n", "marked", "a", "b"])

    cuts = F.pandas_udf(scanned, "n long, marked boolean, a long, b long")
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(_draws(F.col("doc_id"), seed), 1)])
    d = d.withColumn("cut", cuts("text", "h1", "h2"))
    whole = (F.col("cut.n") == 0) | F.col("cut.marked") | (F.col("h3") % 100 >= rate)
    d = d.withColumn("form", F.when(whole, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm"))
    prefix = F.substring("text", F.lit(1), F.col("cut.a"))
    middle = F.substring("text", F.col("cut.a") + 1, F.col("cut.b") - F.col("cut.a"))
    suffix = F.substring("text", F.col("cut.b") + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    plain = F.col("form") == "plain"
    return d.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(~plain, F.col("cut.a")).alias("prefix_chars"),
        F.when(~plain, F.col("cut.b") - F.col("cut.a")).alias("middle_chars"),
        F.when(plain, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` of.

    A text that holds a sentinel is never cut, and as a sentinel begins with its only ``<`` none can arise
    at a seam; so each occurs once, where the parts meet.
    """
    parts = F.split(output, "<[PSM]>")
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


#: DuckDB SQL for the query ``op13_fill_in_middle``.
SQL = """WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
hashed AS (SELECT doc_id, t, n,
  CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM drawn),
cut AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
