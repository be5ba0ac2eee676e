"""Porter's stemmer of 1980 as SQL expressions over a consonant-vowel shape.

Every word is folded to a string of c and v of the same length, in which the
measure of a stem is the number of "vc", a vowel is a "v", and so on. The
steps are plain CASE expressions, so they run in Spark without Python, and the
same text runs in other SQL engines. They are meant for distinct terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Suffixes and what they become, in the order they are tried; the first that fits ends its step.
STEP_2 = (
    "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|"
    "ization ize|ation ate|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
)
STEP_3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _shape(s: str) -> str:
    """y is a consonant at the start and after a vowel. Each round settles one more y of a run."""
    out = f"regexp_replace(regexp_replace({s}, '[aeiou]', 'v'{{g}}), '[^vy]', 'c'{{g}})".replace("'[aeiou]', 'v'", "'[aeiou]', 'V'").replace("'[^vy]', 'c'", "'[^Vy]', 'C'")
    out = f"regexp_replace({out}, '^y', 'C')"
    for _ in range(3):
        out = f"regexp_replace(regexp_replace({out}, 'Cy', 'CV'{{g}}), 'Vy', 'VC'{{g}})"
    return f"lower({out})"


def _m(h: str) -> str:
    return f"(length({h}) - length(replace({h}, 'vc', ''))) / 2"


def _cut(x: str, n: int) -> str:
    return f"left({x}, length(s) - {n})"


def _case(rules: list[tuple[str, str]], otherwise: str = "s") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rules) + f" ELSE {otherwise} END"


def _suffixes(table: str, least: int) -> str:
    rules = []
    for rule in table.split("|"):
        old, new = rule.split(" ")
        rules.append((f"s LIKE '%{old}'", f"CASE WHEN {_m(_cut('h', len(old)))} > {least} THEN concat({_cut('s', len(old))}, '{new}') ELSE s END"))
    return _case(rules)


def _steps() -> list[tuple[str, bool]]:
    """Expressions of s (the word so far), h (its shape) and f (whether step 1b cut); (new s or f, is f)."""
    double = "right(h, 1) = 'c' AND right(s, 1) = left(right(s, 2), 1) AND length(s) > 1"
    cvc = "right({h}, 3) = 'cvc' AND right({s}, 1) NOT IN ('w', 'x', 'y')"
    four = []
    for x in STEP_4.split():
        more = f" AND right({_cut('s', 3)}, 1) IN ('s', 't')" if x == "ion" else ""
        four.append((f"s LIKE '%{x}'", f"CASE WHEN {_m(_cut('h', len(x)))} > 1{more} THEN {_cut('s', len(x))} ELSE s END"))
    ed, ing = f"s LIKE '%ed' AND s NOT LIKE '%eed' AND {_cut('h', 2)} LIKE '%v%'", f"s LIKE '%ing' AND {_cut('h', 3)} LIKE '%v%'"
    return [
        (_case([("s LIKE '%sses'", _cut("s", 2)), ("s LIKE '%ies'", _cut("s", 2)), ("s LIKE '%s' AND s NOT LIKE '%ss'", _cut("s", 1))]), False),
        (f"({ed}) OR ({ing})", True),
        (_case([("s LIKE '%eed'", f"CASE WHEN {_m(_cut('h', 3))} > 0 THEN {_cut('s', 1)} ELSE s END"), (ed, _cut("s", 2)), (ing, _cut("s", 3))]), False),
        (
            _case(
                [
                    ("NOT f", "s"),
                    ("s LIKE '%at' OR s LIKE '%bl' OR s LIKE '%iz'", "concat(s, 'e')"),
                    (f"{double} AND right(s, 1) NOT IN ('l', 's', 'z')", _cut("s", 1)),
                    (f"NOT ({double}) AND {_m('h')} = 1 AND {cvc.format(h='h', s='s')}", "concat(s, 'e')"),
                ]
            ),
            False,
        ),
        (_case([(f"s LIKE '%y' AND {_cut('h', 1)} LIKE '%v%'", f"concat({_cut('s', 1)}, 'i')")]), False),
        (_suffixes(STEP_2, 0), False),
        (_suffixes(STEP_3, 0), False),
        (_case(four), False),
        (
            _case(
                [
                    (
                        f"s LIKE '%e' AND ({_m(_cut('h', 1))} > 1 OR ({_m(_cut('h', 1))} = 1 AND NOT ({cvc.format(h=_cut('h', 1), s=_cut('s', 1))})))",
                        _cut("s", 1),
                    )
                ]
            ),
            False,
        ),
        (_case([(f"{_m('h')} > 1 AND {double} AND right(s, 1) = 'l'", _cut("s", 1))]), False),
    ]


def stemmed(df: DataFrame, term: str = "term", out: str = "stem") -> DataFrame:
    """The rows with their term's stem. Words of one or two characters are their own stems; null stays null."""
    shape = _shape("s").replace("{g}", "")
    rows = df.selectExpr("*", f"`{term}` AS s", f"false AS f")
    for rule, flag in _steps():
        rows = rows.selectExpr("*", f"{shape} AS h")
        rows = rows.selectExpr(*[f"`{c}`" for c in df.columns], "s" if flag else f"{rule} AS s", f"{rule} AS f" if flag else "f")
    return rows.selectExpr(*[f"`{c}`" for c in df.columns], f"CASE WHEN length(`{term}`) <= 2 THEN `{term}` ELSE s END AS `{out}`")


def stem_sql(source: str, term: str = "term") -> str:
    """The same steps as one query over a table expression with a column of terms, for engines with a 'g' flag."""
    shape = _shape("s").replace("{g}", ", 'g'")
    query = f"SELECT {term} AS term, {term} AS s, false AS f FROM ({source})"
    for rule, flag in _steps():
        query = f"SELECT term, {'s' if flag else rule + ' AS s'}, {rule + ' AS f' if flag else 'f'} FROM (SELECT *, {shape} AS h FROM ({query}))"
    return f"SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE s END AS stem FROM ({query})"
