"""Size of a text in tokens of the public word/punctuation tokenizer."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words (letters, digits, underscore) or runs of other signs; blanks are the Unicode white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{Z}\x1c-\x1f\x85\p{L}\p{N}_]+"


def n_tokens(text: Column | str) -> Column:
    """Number of tokens of the whole text; 0 for null and blank."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0)).cast("long")
