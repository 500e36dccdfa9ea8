"""Text columns: cleaning, hashes, near-duplicate features, decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from pagemill.functions.urls import let
from pagemill.functions.values import (
    CHAR_BUCKET, EMAIL_MASK, EMAIL_PATTERN, MIN_SIGNIFICANT_LENGTH, STOP_WORDS, TOP_WORDS, WORD_BUCKET, WS,
)


# Runs of white space that are not one space already: text that is collapsed is looked through, not built anew.
RUNS = f" {WS}++|{WS.replace('-' + chr(92) + 'x20', '-' + chr(92) + 'x1f')}{WS}*+"


def collapse_ws(text: Column) -> Column:
    """Trim, and make every run of (Unicode) white space one space."""
    return F.trim(F.regexp_replace(text, RUNS, " "))


def clean_text(text: Column) -> Column:
    """Null becomes ''; white space collapsed; e-mail addresses masked."""

    def masked(flat: Column) -> Column:
        # The '@' test keeps the address pattern off texts that cannot match.
        return F.when(
            F.contains(flat, F.lit("@")), F.regexp_replace(flat, "(?U)" + EMAIL_PATTERN, EMAIL_MASK)
        ).otherwise(flat)

    return F.coalesce(let(collapse_ws(text), masked), F.lit(""))


def word_count(cleaned: Column) -> Column:
    """Words of an already cleaned text."""
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit(0)).otherwise(
        F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "), F.lit(""))) + 1
    )


def normalized(text: Column) -> Column:
    """Lower-cased and collapsed: what hashes and features are made of."""
    return collapse_ws(F.lower(text))


def content_hash(text: Column, normal: Column | None = None) -> Column:
    """SHA-256 of the lower-cased, collapsed text, or of ``normal``, where that is at hand; null if there is no text."""
    return F.when(text != "", F.sha2(normalized(text) if normal is None else normal, 256))


def title_hash(text: Column) -> Column:
    return F.when(text != "", F.md5(normalized(text)))


def _top_words(significant: Column, k: int) -> Column:
    """The ``k`` most frequent words; ties go to the word seen first.

    Sorting (word, position) puts equal words side by side, so counts are
    distances between run starts: O(n log n) inside the row, no shuffle.
    """

    def ranked(runs: Column) -> Column:
        numbered = F.transform(
            runs, lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), x["w"].alias("w"))
        )
        starts = F.filter(numbered, lambda x: ~x["w"].eqNullSafe(F.get(runs, x["i"] - 1)["w"]))
        return let(
            starts,
            lambda s: F.slice(
                F.sort_array(
                    F.transform(
                        s,
                        lambda x, j: F.struct(
                            (x["i"] - F.coalesce(F.get(s, j + 1)["i"], F.size(runs))).alias("neg_count"),
                            x["p"].alias("p"),
                            x["w"].alias("w"),
                        ),
                    )
                ),
                1,
                k,
            )["w"],
        )

    with_position = F.transform(significant, lambda w, p: F.struct(w.alias("w"), p.alias("p")))
    return F.when(F.size(significant) == 0, F.array().cast("array<string>")).otherwise(
        let(F.sort_array(with_position), ranked)
    )


def fuzzy_features(content: Column, title: Column, normal: Column | None = None) -> Column:
    """Length buckets, title length and top words: equal for near-equal pages.

    Null if there is no content.  One row-local expression per page.
    """

    def features(words: Column) -> Column:
        significant = F.filter(
            words, lambda w: (F.length(w) >= MIN_SIGNIFICANT_LENGTH) & ~w.isin(*STOP_WORDS)
        )
        return let(
            significant,
            lambda s: F.struct(
                F.floor(F.size(words) / F.lit(WORD_BUCKET)).cast("bigint").alias("word_count_bucket"),
                F.floor(F.length(content) / F.lit(CHAR_BUCKET)).cast("bigint").alias("char_count_bucket"),
                F.coalesce(word_count(collapse_ws(title)), F.lit(0)).cast("bigint").alias("title_words"),
                F.size(s).cast("bigint").alias("significant_words"),
                _top_words(s, TOP_WORDS).alias("top_words"),
            ),
        )

    words = F.filter(F.split(normalized(content) if normal is None else normal, " "), lambda w: w != "")
    return F.when(content != "", let(words, features))


def fuzzy_hash_of(features: Column) -> Column:
    """One hash per distinct feature set.  Words hold no spaces, so the text form is unambiguous."""
    return F.md5(
        F.concat_ws(
            " ",
            features["word_count_bucket"], features["char_count_bucket"],
            features["title_words"], features["significant_words"],
            F.array_join(features["top_words"], " "),
        )
    )


def fuzzy_hash(content: Column, title: Column, normal: Column | None = None) -> Column:
    return F.when(content != "", let(fuzzy_features(content, title, normal), fuzzy_hash_of))


# Names under which the two encodings Spark decodes itself are declared.
_UTF8_NAMES = ("utf-8", "utf8", "u8", "us-ascii", "ascii")
_LATIN1_NAMES = ("iso-8859-1", "iso8859-1", "latin-1", "latin1", "l1")


_DECODED = StructType([StructField("known", BooleanType()), StructField("text", StringType())])


@F.pandas_udf(_DECODED)
def _decode_foreign(body: pd.Series, charset: pd.Series) -> pd.DataFrame:
    """Strict decode in a charset Spark does not offer itself."""

    def one(raw, name):
        if raw is None or name is None:
            return False, None
        try:
            return True, bytes(raw).decode(name)
        except UnicodeDecodeError:
            return True, None
        except (LookupError, ValueError):  # unknown, or a name no codec can take
            return False, None

    return pd.DataFrame([one(raw, name) for raw, name in zip(body, charset)], columns=["known", "text"])


def decode_body(body: Column, charset: Column) -> Column:
    """Raw response to text: declared charset, else UTF-8, else Latin-1.

    A charset nobody knows gives null.  Only rows with a charset other than
    the two native ones travel to Python; the others are sent as nulls.
    """
    name = F.lower(F.trim(F.coalesce(charset, F.lit("utf-8"))))
    foreign = ~name.isin(*_UTF8_NAMES, *_LATIN1_NAMES)
    latin1 = F.decode(body, "ISO-8859-1")
    fallback = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(latin1)
    declared = _decode_foreign(F.when(foreign, body), F.when(foreign, name))
    return (
        F.when(name.isin(*_UTF8_NAMES), fallback)
        .when(name.isin(*_LATIN1_NAMES), latin1)
        .when(declared["known"], F.coalesce(declared["text"], fallback))
    )
