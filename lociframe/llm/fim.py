"""Fill-in-the-middle: a text's prefix, middle and suffix in the order that trains infilling.

A text is cut between units, a unit being a word with the white space before it, or white
space at the end. The cuts, whether a text is rearranged at all, and in which of two orders,
follow from a SHA-256 of the seed and the doc_id, so that reruns and retried tasks agree:
with ``h1`` to ``h4`` the first four groups of eight hexadecimal digits and ``n`` units, the
prefix ends after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units and the middle
after the larger, a text is rearranged where ``h3 % 100 < rate``, and the suffix comes first
where ``h4 % 100 < suffix_first``.

Defined cases: a null text counts as empty. An empty text, and one that holds a mark, stay as
they are (``plain``), so that every output can be turned back. A null doc_id counts as empty
digits. Rows that share a doc_id are cut by the same hashes, each by its own number of units.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with the white space before it, or white space at the end of a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"
MADE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@dataclass(frozen=True)
class Settings:
    """``rate``: texts of 100 that are rearranged; ``suffix_first``: of 100 of these, whose suffix comes first. No mark may hold another or begin with the end of one."""

    seed: str = "42"
    rate: int = 50
    suffix_first: int = 80
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark

    def __post_init__(self) -> None:
        if not all(self.marks) or len(set(self.marks)) < 3:
            raise ValueError("marks must be three different strings")
        for a in self.marks:
            for b in self.marks:
                if a != b and b in a or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"mark {b!r} may be found in or across the end of mark {a!r}")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rearrange(doc_id: str, text: str, settings: Settings, unit: regex.Pattern) -> tuple[int, str, int | None, int | None, str, str]:
    """Number of units, form, characters of prefix and middle, the output, and its SHA-256."""
    ends = array("I", (m.end() for m in unit.finditer(text)))
    n = len(ends)
    seed = digest(f"{settings.seed}:{doc_id}")
    h1, h2, h3, h4 = (int(seed[i : i + 8], 16) for i in range(0, 32, 8))
    if not n or h3 % 100 >= settings.rate or any(m in text for m in settings.marks):
        return n, PLAIN, None, None, text, digest(text)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[last - 1] if last else 0
    prefix, suffix = settings.prefix_mark + text[:a], settings.suffix_mark + text[b:]
    form = SUFFIX_FIRST if h4 % 100 < settings.suffix_first else PREFIX_FIRST
    output = (suffix + prefix if form == SUFFIX_FIRST else prefix + suffix) + settings.middle_mark + text[a:b]
    return n, form, a, b - a, output, digest(output)


def put_back(form: str, output: str, settings: Settings) -> str:
    """The text that was rearranged to ``output``; each mark stands in it once."""
    if form == PLAIN:
        return output
    prefix, suffix, middle = (output.index(m) for m in settings.marks)
    a, b = output[prefix + len(settings.prefix_mark) : suffix if form == PREFIX_FIRST else middle], output[suffix + len(settings.suffix_mark) : middle if form == PREFIX_FIRST else prefix]
    return a + output[middle + len(settings.middle_mark) :] + b


def transform(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): doc_id and the columns of ``MADE``; other columns are not read."""

    @F.pandas_udf(MADE)
    def made(doc_ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        unit = regex.compile(UNIT)
        rows = [rearrange(i, t or "", settings, unit) for i, t in zip(doc_ids, texts, strict=True)]
        n, form, prefix, middle, output, sha = zip(*rows, strict=True) if rows else [()] * 6
        chars = {"prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64")}
        return pd.DataFrame({"n": pd.array(n, "int64"), "form": form} | chars | {"output": output, "output_sha256": sha})

    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", made(digits, "text").alias("__made")).select("doc_id", "__made.*")


def restore(form: Column, output: Column, settings: Settings = Settings()) -> Column:
    """A struct of the text behind each output and its SHA-256: text, sha256."""

    @F.pandas_udf("text string, sha256 string")
    def back(forms: pd.Series, outputs: pd.Series) -> pd.DataFrame:
        texts = [put_back(f, o, settings) for f, o in zip(forms, outputs, strict=True)]
        return pd.DataFrame({"text": texts, "sha256": list(map(digest, texts))})

    return back(form, output)
