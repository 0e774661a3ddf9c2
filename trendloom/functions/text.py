"""Column expressions that clean, trim and tokenise text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accent escapes and the letters they stand for.
ACCENTS = [
    ('\\"A', "Ä"), ('\\"a', "ä"), ("\\'A", "Á"), ("\\'a", "á"), ("\\^A", "Â"), ("\\^a", "â"),
    ("\\`A", "À"), ("\\`a", "à"), ("\\r{A}", "Å"), ("\\r{a}", "å"),
    ("\\c{C}", "Ç"), ("\\c{c}", "ç"),
    ("\\'E", "É"), ("\\'e", "é"), ("\\^E", "Ê"), ("\\^e", "ê"), ("\\`E", "È"), ("\\`e", "è"),
    ("\\~N", "Ñ"), ("\\~n", "ñ"),
    ('\\"O', "Ö"), ('\\"o', "ö"), ("\\'O", "Ó"), ("\\'o", "ó"), ("\\`O", "Ò"), ("\\`o", "ò"),
    ('\\"U', "Ü"), ('\\"u', "ü"), ("\\'U", "Ú"), ("\\'u", "ú"), ("\\`U", "Ù"), ("\\`u", "ù"),
    ("{\\O}", "Ø"), ("{\\o}", "ø"), ("{\\oe}", "œ"), ("{\\ss}", "ß"),
]

# Patterns and replacements, applied one after the other. The last one is safe on
# long bodies as it stands; do not turn it into an alternation (it would recurse per character).
CLEANING = [
    (r"\n", " "),
    (r"  +", " "),
    (r"[\(\[][aA](bridged|BRIDGED)(\.)?[\)\]]", ""),
    (r"(\()?(Context|CONTEXT):(\))?", ""),
    (r"\$\[?([a-zA-Z])\]?\$", "$1"),
    (r"\$\\[\p{L}\p{N}_]+\{([a-zA-Z])\}\$", "$1"),
    (r"\$\\(mbf|mit|mbfit|mscr|mbfscr|mfrak|Bbb|mbffrak|mtt)(sans)?([a-zA-Z])\$", "$3"),
    (r"\$\\([\p{L}\p{N}_]+)\$", "$1"),
    (r"(\${1,2})(?:(?!\1)[\s\S])*\1", "(formula)"),
]

# How the abstracts of withdrawn papers begin.
WITHDRAWN = [
    " This article has been removed", " This paper has been removed",
    " This submission has been removed", " This manuscript has been removed",
    " This article has been withdrawn", " The paper has been withdrawn",
    " This paper has been withdrawn", " This submission has been withdrawn",
    " This manuscript has been withdrawn", " This submission is a duplicate",
    " Withdrawn", " Paper withdrawn", " The article was withdrawn", " The paper was withdrawn",
    " This paper was withdrawn", " The paper is being withdrawn",
    " This paper is being withdrawn",
]

# Length limits of an abstract and the characters trimmed off labels.
MIN_LENGTH = 64
MAX_LENGTH = 1024
LABEL_TRIM = " '`\"*.?"

# Common English words that describe no topic, and the formula marker.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below
between both but by can cannot could did do does doing down during each few for from further had
has have having he her here hers herself him himself his how i if in into is it its itself just me
more most my myself no nor not now of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they this
those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves formula
""".split()


def clean_accents(text: Column) -> Column:
    """Accent escapes become the letters they stand for."""
    for escape, letter in ACCENTS:
        text = F.replace(text, F.lit(escape), F.lit(letter))
    return text


def clean_text(text: Column) -> Column:
    """One line of plain text: artefacts dropped, simple formulae spelled out, others marked."""
    for pattern, replacement in CLEANING:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def is_withdrawn(abstract: Column) -> Column:
    test = F.lit(False)
    for phrase in WITHDRAWN:
        test = test | abstract.startswith(phrase)
    return test


def split_sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before white space and a capital letter or digit."""
    return F.split(F.btrim(text), r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}])")


def trim_sentences(sentences: Column, limit: int = MAX_LENGTH) -> Column:
    """The first sentence and those after it that keep the joined text within ``limit``."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"))

    def step(state: Column, sentence: Column) -> Column:
        first = state["kept"] == 0
        size = state["used"] + F.length(sentence)
        fits = first | (size < limit)
        return F.struct(
            # a sentence that does not fit fills the text, so none after it fits
            F.when(fits, size + F.when(first, 0).otherwise(1)).otherwise(limit).alias("used"),
            F.when(fits, state["kept"] + 1).otherwise(state["kept"]).alias("kept"),
        )

    # a first sentence of no length still counts as kept
    kept = F.aggregate(sentences, start, step, lambda state: state["kept"])
    return F.array_join(F.slice(sentences, 1, F.greatest(kept, F.lit(1))), " ")


def clean_label(label: Column) -> Column:
    return F.btrim(F.replace(label, F.lit("&quot;"), F.lit("")), F.lit(LABEL_TRIM))


def words(text: Column) -> Column:
    """Lower-case words of at least two letters, digits or underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def remove_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda word: ~word.isin(list(stop_words)))


def ngrams(tokens: Column, start: int = 1, end: int = 2) -> Column:
    """All runs of ``start`` to ``end`` neighbouring tokens, joined by a space.

    Longer runs come from pairing the list with itself shifted: no lambda holds ``tokens``, which
    would be worked out anew for every element.
    """
    runs, run = [], tokens
    for size in range(1, end + 1):
        if size > 1:
            shifted = F.slice(tokens, size, F.size(tokens))
            paired = F.zip_with(run, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
            run = F.filter(paired, lambda x: x.isNotNull())
        if size >= start:
            runs.append(run)
    return F.concat(*runs)


def terms(text: Column, start: int = 1, end: int = 2, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return ngrams(remove_stop_words(words(text), stop_words), start, end)


def topic_name(topic: Column, top_words: Column) -> Column:
    return F.concat_ws("_", topic.cast("string"), F.slice(top_words, 1, 4))
