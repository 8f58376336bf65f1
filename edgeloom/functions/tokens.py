"""Source text as a fold over its marks: code, comments (nested too) and literals told apart.

A text is split into marks by one pattern; a state of three fields (what the text is in, how
deep, and the mark before) goes along them in an ``aggregate``, so a file is read once, by a
built-in expression, whatever its line ends, comments and strings hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE, LINE, BLOCK, STRING, RAW = range(5)

#: Marks that can change the state; all else is blank or plain text.
MARKS = r'r#*"|[/*"\\\n]|#+'
_RAW_OPENING = r'^r#*"$'
_BLANK = r"(?U)^\s*$"


def tokens(text: Column | str, also: str = "") -> Column:
    """The marks of a text, with the runs between them; ``also`` (patterns joined by |) are tried first."""
    first = f"{also}|" if also else ""
    return F.regexp_extract_all(text, F.lit(rf"(?U){first}{MARKS}|\r+(?=\n|\z)|[\s&&[^\n]]+|(?:(?!{first}r#*\")[^/*\"\\#\s])+"), F.lit(0))


def after(kind: Column, level: Column, prev: Column, token: Column) -> tuple[Column, Column, Column]:
    """The state (kind, level, mark before) behind ``token``: ``level`` counts open comments, or the hashes of a raw string."""
    raw = token.rlike(_RAW_OPENING)
    quote = (token == '"') | raw
    opens, closes = (prev == "/") & (token == "*"), (prev == "*") & (token == "/")
    in_code = F.when((prev == "/") & (token == "/"), LINE).when(opens, BLOCK).when(token == '"', STRING).when(raw, RAW).otherwise(CODE)
    ends = F.when(level == 0, quote).otherwise((prev == '"') & token.startswith("#") & (F.char_length(token) >= level))
    new_kind = (
        F.when(kind == CODE, in_code)
        .when(kind == LINE, F.when(token.contains("\n"), CODE).otherwise(LINE))
        .when(kind == BLOCK, F.when(closes & (level == 1), CODE).otherwise(BLOCK))
        .when(kind == STRING, F.when(raw | ((token == '"') & (prev != "\\")), CODE).otherwise(STRING))
        .otherwise(F.when(ends, CODE).otherwise(RAW))
    )
    new_level = (
        F.when(kind == CODE, F.when(opens, 1).when(raw, F.char_length(token) - 2).otherwise(0))
        .when(kind == BLOCK, F.when(opens, level + 1).when(closes, level - 1).otherwise(level))
        .when(kind == RAW, level)
        .otherwise(0)
    )
    slash, escaped = (token == "/") & (prev != "/"), prev == "\\"
    new_prev = (
        F.when(kind == CODE, F.when(slash, "/").otherwise(""))
        .when(kind == BLOCK, F.when((token == "*") & ~opens, "*").when((token == "/") & ~closes, "/").otherwise(""))
        .when(kind == STRING, F.when((token == "\\") & ~escaped, "\\").when(escaped & token.rlike(r"^(?:\r+|\n)$"), "\\").otherwise(""))
        .when(kind == RAW, F.when(quote & (level > 0), '"').otherwise(""))
        .otherwise("")
    )
    return new_kind, new_level, new_prev


def lines_of_code(text: Column | str) -> Column:
    """How many lines hold something besides blanks and comments; lines inside a literal do, and null has none."""
    start = F.expr("named_struct('kind', 0, 'level', 0, 'prev', '', 'code', false, 'n', cast(0 as bigint))")
    one = lambda code: F.when(code, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    def step(s: Column, token: Column) -> Column:
        kind, level, prev = after(s["kind"], s["level"], s["prev"], token)
        lone = (s["prev"] == "/") & ~token.isin("/", "*")  # a slash that opened no comment
        comment = (token == "/") | ((s["prev"] == "/") & (token == "*"))
        code = s["code"] | ((s["kind"] == CODE) & (lone | ~(comment | token.rlike(_BLANK))))
        end = token == "\n"
        literal = kind.isin(STRING, RAW)
        return F.struct(kind.cast("int").alias("kind"), level.cast("int").alias("level"), prev.alias("prev"), F.when(end, literal).otherwise(code).alias("code"), (s["n"] + F.when(end, one(code)).otherwise(0)).alias("n"))

    last = lambda s: s["n"] + one(s["code"] | ((s["kind"] == CODE) & (s["prev"] == "/")))
    return F.coalesce(F.aggregate(tokens(text), start, step, last), F.lit(0).cast("bigint"))
