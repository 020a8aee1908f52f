"""Quality rules: a table of thresholds, compiled into one projection.

Every statistic is an SQL expression over the text of its own row; no user
function, no shuffle.  Words are runs of characters other than space and
U+0009 to U+000D.

Defined results: a null text counts as an empty one (all counts 0, no ratio);
ties do not arise, as rows are judged one by one; repeated rows give repeated
results; an empty table gives an empty one; columns of the input are kept
under their names, and a statistic replaces an input column of its name.  A very
long text is judged whole, in its row; its windows are hashed and sorted there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.sql import each, keep, let, quote

BLANKS = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the languages that are judged.
STOP_WORDS = (
    "the of and to a in is that for it was on are as with be this by at from what or you have not but "
    "der die das und ist nicht ein eine von zu den mit sich des auf für im dem als auch "
    "el la los las de que y en un una por con para no es se del lo como su al "
    "le les des et à est une dans qui que pour pas sur au du il elle ce avec ne"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the statistic must lie within the limits."""

    name: str
    statistic: str
    least: float | None = None
    most: float | None = None

    def failed(self) -> str:
        tests = []
        if self.least is not None:
            tests.append(f"{self.statistic} < {self.least!r}")
        if self.most is not None:
            tests.append(f"{self.statistic} > {self.most!r}")
        return f"coalesce({' OR '.join(tests)}, false)"  # a ratio without a base breaks no rule


#: What a text must satisfy besides the base rules.
RULES = (
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", None, 0.1),
    Rule("shout_ratio", "n_shouts / nullif(n_words, 0)", None, 0.4),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines / nullif(n_lines, 0)", None, 0.3),
)


def word_list(text: str) -> str:
    """The words of a text, in order."""
    plain = f"translate({text}, {quote(BLANKS)}, {quote(' ' * len(BLANKS))})"
    return f"array_remove(split({plain}, ' '), '')"


def chars_among(text: str, wanted: str) -> str:
    """How many characters of a text are among the wanted ones."""
    return f"(char_length({text}) - char_length(translate({text}, {quote(wanted)}, '')))"


def repeated_words(words: str, window: int = WINDOW) -> str:
    """How many words lie in a window of words that the text holds twice or more.

    Distinct hashes of all windows prove most texts free of repeats.  Only the
    others get their windows sorted, as text with position, and compared with
    their neighbours; the words of repeated windows are then counted once each.
    """
    last = f"size({words}) - {window}"
    hashed = each(f"sequence(0, {last})", lambda i: "xxhash64(" + ", ".join(f"{words}[{i} + {k}]" for k in range(window)) + ")")
    windows = each(
        f"sequence(0, {last})",
        lambda i: f"named_struct('w', concat_ws(' ', {', '.join(f'{words}[{i} + {k}]' for k in range(window))}), 'i', {i})",
    )

    def covered(ordered: str) -> str:
        same = lambda a, b: f"coalesce(get({ordered}, {a}).w = get({ordered}, {b}).w, false)"
        hits = keep(f"sequence(0, {last})", lambda k: f"({same(k, f'{k} - 1')} OR {same(k, f'{k} + 1')})")
        starts = f"array_sort({each(hits, lambda k: f'{ordered}[{k}].i')})"
        return let(
            starts,
            lambda s: f"aggregate(zip_with({s}, slice({s}, 2, greatest(size({s}), 1)), "
            f"(a, b) -> least({window}, coalesce(b - a, {window}))), 0, (sum, x) -> sum + x)",
        )

    several = let(hashed, lambda h: f"size(array_distinct({h})) < size({h})")
    return f"CASE WHEN size({words}) <= {window} THEN 0 WHEN {several} THEN {let(f'array_sort({windows})', covered)} ELSE 0 END"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts that rules refer to, as long columns behind the columns of the input."""
    stop_list = ", ".join(map(quote, STOP_WORDS))
    fields = {
        "n_words": "size(w)",
        "word_chars": "char_length(concat_ws('', w))",
        "n_symbols": chars_among("t", SYMBOLS),
        "n_lines": f"size({_LINES})",
        "n_dup_lines": let(_LINES, lambda lines: f"size({lines}) - size(array_distinct({lines}))"),
        "n_repeat_words": repeated_words("w"),
        "n_stop_words": f"size({keep('w', lambda x: f'lower({x}) IN ({stop_list})')})",
        "n_shouts": f"size({keep('w', lambda x: f'char_length({x}) > 1 AND upper({x}) = {x} AND lower({x}) <> {x}')})",
    }
    struct = "named_struct(" + ", ".join(f"'{k}', cast({v} AS bigint)" for k, v in fields.items()) + ")"
    counted = f"get(transform(array(coalesce({text}, '')), t -> get(transform(array({word_list('t')}), w -> {struct}), 0)), 0)"
    rest = [c for c in docs.columns if c.lower() not in fields]
    return docs.select(*(F.col(f"`{c}`") for c in rest), F.expr(counted).alias("__counts")).select(
        *(F.col(f"`{c}`") for c in rest), "__counts.*"
    )


_LINES = keep("split(t, '\\n')", lambda line: f"translate({line}, {quote(BLANKS)}, '') <> ''")


def judge(counted: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Add `base_failed`, `failed_rules` (names, in the order of the table) and `kept`."""
    base = f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words"
    names = f"array_compact(array({', '.join(f'CASE WHEN {r.failed()} THEN {quote(r.name)} END' for r in rules)}))"
    return counted.withColumns({"base_failed": F.expr(base), "failed_rules": F.expr(names)}).withColumn(
        "kept", F.expr("NOT base_failed AND size(failed_rules) = 0")
    )
