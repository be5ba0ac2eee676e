"""Analysers, and the text functions of expansion and parsing, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words that results depend on.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were been "
    "be have has had do does did will would could should may might must shall can need it its "
    "this that these those i you he she we they what which who whom when where why how all "
    "each every both few more most other some such no nor not only own same so than too very "
    "just also now"
).split()

#: The shorter list of the second analyser.
STOP_WORDS_SHORT = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did "
    "will would it its this that these those i you he she we they what which who when where why how all each "
    "both few more most other some no not only same so than too very just"
).split()

#: Words that say nothing in an expansion.
GENERIC_WORDS = "information details things stuff content topic subject example case way method people time place thing".split()

#: What Python's strip() and split() take as white space, for Java's regular expressions.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def literal_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def tokens(text: Column, analyzer: str = "ascii") -> Column:
    """The terms of a text, in order, before stemming; a null text has none.

    ascii: runs of ASCII letters and digits, then lower case, longer than one character, no stop word.
    lower: lower case first (which can make ASCII letters of others), same runs, the shorter stop list, any length.
    """
    text = F.coalesce(text, F.lit(""))
    if analyzer == "ascii":
        found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
        return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))
    if analyzer == "lower":
        found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
        return F.filter(found, lambda t: ~t.isin(STOP_WORDS_SHORT))
    raise ValueError(f"no analyzer {analyzer}")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """The parts between Unicode white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Cut at white space after . ! or ?"""
    return F.split(text, r"(?<=[.!?])\s+")


def added_sentences(original: Column, expanded: Column, least: int = 15) -> Column:
    """The sentences an expanded text adds to its original, of more than least characters; none if it doesn't start so."""
    added = strip(F.substring(expanded, F.length(original) + 1, F.length(expanded)))
    kept = F.filter(F.transform(sentences(added), strip), lambda s: F.length(s) > least)
    return F.when(F.startswith(expanded, original), kept).otherwise(F.array().cast("array<string>"))


def useful_expansions(expansions: Column, doc: Column, least: int = 3, most: int = 50, generic: float = 0.5) -> Column:
    """Stripped expansions of least to most words, not mostly of generic words, and not part of the text in any case."""

    def fine(e: Column) -> Column:
        own = words(F.lower(e))
        said = F.size(F.filter(own, lambda w: w.isin(GENERIC_WORDS)))
        part = F.coalesce(F.contains(F.lower(doc), F.lower(e)), F.lit(False))
        return (F.size(own) >= least) & (F.size(own) <= most) & (said / F.size(own) <= generic) & ~part

    known = F.filter(F.coalesce(expansions, F.array().cast("array<string>")), lambda e: e.isNotNull())
    return F.filter(F.transform(known, strip), fine)


def parsed_lines(answer: Column, least: int = 5, most: int = 5) -> Column:
    """The items of a model's answer: without numbers and dashes before them, blank lines and headings; the first few."""

    def bare(line: Column) -> Column:
        line = strip(line)
        numbered = F.regexp_like(line, F.lit(r"^\p{Nd}")) & F.contains(line, F.lit("."))
        line = F.when(numbered, strip(F.regexp_replace(line, r"(?s)^[^.]*\.", ""))).otherwise(line)
        return F.when(F.startswith(line, F.lit("-")), strip(F.substring(line, 2, 1 << 30))).otherwise(line)

    lines = F.filter(F.transform(F.split(answer, "\n"), strip), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.slice(F.filter(F.transform(lines, bare), lambda x: F.length(x) > least), 1, most)


def joined(doc: Column, expansions: Column) -> Column:
    """The text with its expansions after it; the space stands even without any."""
    return F.concat(doc, F.lit(" "), F.array_join(expansions, " "))


#: The prompts.
GAP_PROMPT = "Analyze this document and list semantic gaps (max 5):\n{document}\n\nGaps:"
EXPAND_PROMPT = "Generate brief factual expansions for this document:\n{document}\n\nGaps: {gaps}\n\nExpansions:"
PASSAGE_PROMPT = "Add 2-3 factual sentences to expand this passage. Only add information that is factually consistent.\n\nPassage: {document}\n\nExpansion:"
CHAT = ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n")
INSTRUCT = ("[INST] ", " [/INST]")


def filled(template: str, frame: tuple[str, str], **parts: Column) -> Column:
    """A prompt: the template with {name} filled in, between the frame's marks. Filled-in text is never a template."""
    out, rest = [F.lit(frame[0])], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), parts[name]]
    return F.concat(*out, F.lit(rest), F.lit(frame[1]))


def entailment_input(premise: Column, hypothesis: Column) -> Column:
    return F.concat(premise, F.lit("</s></s>"), hypothesis)
