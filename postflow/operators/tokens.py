"""Token arrays and chunked text mapping."""

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.functions import text as tx
from postflow.functions.stem import english_stem, stem_tokens


def clean_text(
    posts: DataFrame,
    text: str = "text",
    stop=None,
    library_stop=tx.ENGLISH_STOP_WORDS,
    whitespace: str = "remove",
    stem_fn: Callable[[str], str] | None = english_stem,
) -> DataFrame:
    """Add ``nonstem_tokens`` and, unless ``stem_fn`` is None, ``stem_tokens``.

    The steps run in a fixed order: lower case, noise, stop words, emoji, punctuation, accents, the
    English stop words once more, residue, split, stems.  Every step up to the split is a JVM
    expression over the whole text; a null text counts as an empty one.
    """
    stop = tx.stop_list() if stop is None else stop
    noiseless = tx.strip_noise(F.lower(F.coalesce(text, F.lit(""))), whitespace)
    cleaned = posts.withColumn("nonstem_tokens", tx.words(noiseless, stop, library_stop))
    if stem_fn is None:
        return cleaned
    return cleaned.withColumn("stem_tokens", stem_tokens("nonstem_tokens", stem_fn))


def map_text(
    df: DataFrame,
    fn: Callable[[pd.Series], pd.Series],
    text: str = "text",
    out: str | None = None,
    chunk: int = 512,
) -> DataFrame:
    """Cut each text into pieces of ``chunk`` characters, map them and join the results.

    ``fn`` gets the pieces of a whole Arrow batch at once, for example to feed a model.  The pieces
    of a text stay in its row, so nothing is shuffled to put them back together.
    """

    @F.arrow_udf("string")
    def mapped(batch: pa.Array) -> pa.Array:
        done = pa.array(fn(batch.flatten().to_pandas()), pa.string())
        sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *sizes.cumsum()], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, done), "")
        return pc.if_else(batch.is_null(), pa.scalar(None, pa.string()), joined)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    return df.withColumn(out or text, mapped(pieces))
