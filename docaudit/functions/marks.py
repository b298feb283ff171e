"""Which patterns occur in the texts of a list, as one vectorised function over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mark_batch(lists: pa.ListArray, regexes: list[str], folded: bool) -> pa.ListArray:
    """Bit n of a text's number: regex n occurs. Equal texts of a batch are looked at once."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    low = coded.dictionary
    if folded:  # the only characters beyond ASCII whose lower case holds an ASCII letter
        low = pc.replace_substring(pc.replace_substring(low, "\u212a", "k"), "\u0130", "i\u0307")
    low, marks = pc.ascii_lower(low), np.zeros(len(low), "i4")
    for n, regex in enumerate(regexes):
        marks |= pc.match_substring_regex(low, regex).to_numpy(zero_copy_only=False).astype("i4") << n
    ends = pa.array(np.append(0, np.cumsum(sizes)).astype("i4"))
    return pa.ListArray.from_arrays(ends, pa.array(marks).take(coded.indices), mask=lists.is_null())


def marks(texts: Column, groups: list[list[str]], folded: bool = False) -> Column:
    """A number for each text of a list; bit n is set if a pattern of group n occurs, in either case.

    As ``functions.text.matches_any`` for patterns without ``\\s`` and ``$``: only ASCII letters have a
    case and only they, digits and ``_`` make words. ``folded`` stands for texts in lower case.
    """
    regexes = ["(?:" + "|".join(patterns) + ")" for patterns in groups]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def marked(lists: pa.Array) -> pa.Array:
        return mark_batch(lists, regexes, folded)

    return marked(texts)


def marked(mark: Column, n: int) -> Column:
    return mark.bitwiseAND(F.lit(1 << n)) != 0
