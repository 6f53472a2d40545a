"""Text rules as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Words and patterns of the rules.
TRIGGER = r"(?i)amendement|scrutin|voi[xe]"
ARTICLE = r"(?i)article\s+([0-9]{1,4})"
NUMBER = r"\b([0-9]{1,4})\b"
NAME = r"\b(?:[Mm]onsieur|[Mm]adame|M\.|Mme)\s+(?:l[ea]\s+)?[A-ZÀÂÉÈÊËÎÏÔÙÛÇ][\p{L}\p{N}_'’-]*(?:\s+[A-ZÀÂÉÈÊËÎÏÔÙÛÇ][\p{L}\p{N}_'’-]*)*"
BALLOT_OPEN = r"(?i)scrutin\s+est\s+ouvert"
BALLOT_REJECTED = r"(?i)(?:est|sont)\s+rejeté|n[e'’]\s*(?:est|sont)\s+pas\s+adopté"
BALLOT_ADOPTED = r"(?i)(?:est|sont)\s+adoptés?"
BALLOT_VOTE = r"(?i)met(?:s|tre)?\s+aux?\s+voi[xe]"
CALL_BEFORE = r"(?i)(?:la parole est à|merci\b|je vous remercie)[^.!?]*$"
CALL_AFTER = r"(?i)^\s*[,–—]?\s*(?:du|pour le)\s+groupe"
STOP = ["m", "mme", "mlle", "monsieur", "madame", "mademoiselle", "le", "la", "les", "l", "de", "du", "des", "president", "presidente", "ministre", "secretaire", "depute", "deputee", "rapporteur", "rapporteure", "orateur", "oratrice"]
CIVILITY = r"^\s*(M\.|Mme|Mlle|Monsieur|Madame|Mademoiselle)\s+"
LAST_VOWEL = r"(?i)[aeiouyàâäéèêëîïôöûü]([^aeiouyàâäéèêëîïôöûü\s]*)$"

LABEL_NUMBER = r"n[°o]\s*([0-9]+)"
AMENDMENT = r"(?i)amendements?\b"
SENTENCE_END = r"[.!?…]\s*$"


def _plain_letters() -> tuple[str, str]:
    """Letters with marks and what is left of each when compatibility decomposition takes the marks off, by the rule."""
    marked, plain = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x530)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if len(base) == 1 and base != c.lower():
            marked.append(c)
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _plain_letters()
# Compatibility letters that stand for several.
_SEVERAL = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "ǆ": "dz", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz"}


def sql_text(pattern: str) -> str:
    """A pattern as the body of an SQL string."""
    return pattern.replace("'", "''")


def unaccent(c: Column) -> Column:
    """Lower case without the marks of Latin letters (precomposed or combining)."""
    out = F.translate(F.lower(c), _MARKED, _PLAIN)
    several = F.when(out.rlike("[" + "".join(_SEVERAL) + "]"), _each(out, _SEVERAL)).otherwise(out)
    return F.regexp_replace(several, r"\p{M}", "")


def _each(c: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalize_name(c: Column) -> Column:
    """Lower case, no marks, only letters, spaces and hyphens, single spaces; null becomes ''."""
    letters = F.regexp_replace(unaccent(F.coalesce(c, F.lit(""))), r"[^\p{L} \-]", " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def name_tokens(c: Column) -> Column:
    """Words of a normalised name without civilities and titles, duplicates kept."""
    return F.filter(F.split(normalize_name(c), " "), lambda x: (x != "") & ~x.isin(*STOP))


def amendment_numbers(c: Column) -> Column:
    """Numbers of 1 to 4 digits in a text with a trigger word, without those after "article"; each once, in order."""
    heard = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1))
    kept = F.transform(F.array_except(heard, F.regexp_extract_all(c, F.lit(ARTICLE), F.lit(1))), lambda x: x.cast("int"))
    return F.when(c.rlike(TRIGGER), F.array_distinct(kept)).when(c.isNotNull(), F.array().cast("array<int>"))


def speaker_names(c: Column) -> Column:
    """Civility and capitalised words, as they were heard."""
    return F.regexp_extract_all(c, F.lit("(?U)" + NAME), F.lit(0))


def ballot_event(c: Column) -> Column:
    """open, rejected, adopted or vote, the first that applies in this order; else null."""
    return F.when(c.rlike(BALLOT_OPEN), "open").when(c.rlike(BALLOT_REJECTED), "rejected").when(c.rlike(BALLOT_ADOPTED), "adopted").when(c.rlike(BALLOT_VOTE), "vote")


def speaker_call(text: Column, name: Column, previous: Column) -> Column:
    """strong, weak or none: whether a name that occurs in a text calls its bearer to speak."""
    at = F.instr(text, name)
    head, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(name), F.length(text))
    open_end = ~F.rtrim(previous).rlike(SENTENCE_END) & (previous != "")
    before = F.when((F.trim(head) == "") & F.coalesce(open_end, F.lit(False)), previous).otherwise(head)
    alone = (F.trim(F.element_at(F.split(before, "[.!?]", -1), -1)) == "") & (F.trim(F.split(after, "[.!?]", 2)[0]) == "")
    call = F.when(after.rlike(CALL_AFTER), "strong").when(before.rlike(CALL_BEFORE), "strong").when(before.rlike(AMENDMENT), "strong").when(alone, "weak").otherwise("none")
    return F.when(at > 0, call).otherwise("none")


def label_number(c: Column) -> Column:
    """The amendment number in a line's label; null without one."""
    return F.nullif(F.regexp_extract(c, LABEL_NUMBER, 1), F.lit(""))


#: Routes by the first pattern that a path matches, and whether what they show is gated by the clock.
ROUTES = [(r"^/derouleur\.json$", "derouleur", True), (r"^/(?:prochainADiscuter|amendement)\.do$", "eliasse", True), (r"^/referential/[^/]+\.json$", "referential", False), (r"^/ground-truth/timeline$", "timeline", False), (r"^/ground-truth/tree$", "tree", False), (r"^/ground-truth/.+$", "ground-truth", False)]


def route(path: Column) -> Column:
    """(name, causal) of the route a path takes; null for none (404)."""
    out = F
    for pattern, name, causal in ROUTES:
        out = out.when(path.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(causal).alias("causal")))
    return out


def strip_civility(c: Column) -> Column:
    return F.regexp_replace(c, CIVILITY, "")


def noisy_name(c: Column) -> Column:
    """The name without its civility and without the last vowel of its last word."""
    words = F.regexp_replace(F.trim(strip_civility(c)), r"\s+", " ")
    return F.regexp_replace(words, LAST_VOWEL, "$1")


def sse_frame(json: Column) -> Column:
    return F.concat(F.lit("data: "), json, F.lit("\n\n"))


def safe_name(c: Column) -> Column:
    """A plain file name: no path, no climbing, no leading dot."""
    return c.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$") & ~c.contains("..")


def unit_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9-]", "-")


def corrected_reply(raw: Column) -> Column:
    """(text, notes) of a reply: without code fence, notes split off and their bullets taken; null if empty."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    fenced = text.startswith("```")
    body = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?```[^\n]*$", "")
    text = F.when(fenced, body).otherwise(text)
    halves = F.split(text, r"(?i)\n\s*NOTES?\s*:\s*\n?", 2)
    main = F.regexp_replace(halves[0], r"^\s+|\s+$", "")
    notes = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[ \-•\t\s]+|[ \-•\t\s]+$", "")), lambda x: x != "")
    return F.when(main != "", F.struct(main.alias("text"), notes.alias("notes")))
