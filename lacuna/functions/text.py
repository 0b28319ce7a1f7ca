"""Rules on characters, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import Profile

#: White space as Unicode has it; Java's \s is ASCII only.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def normalize(text: Column) -> Column:
    """Runs of white space to one space, none at the ends; texts of less than 3 characters are null. As a lambda's variable what is cleaned is computed once."""
    clean = F.trim(F.regexp_replace(text, BLANKS, " "))
    return F.get(F.filter(F.array(clean), lambda c: F.length(c) >= 3), 0)


def pieces(text: Column, profile: Profile) -> Column:
    """The parts between sentence ends, trimmed, ends removed."""
    return F.transform(F.split(text, f"[{profile.terminators}]", -1), lambda s: F.trim(s))


def script_count(text: Column, profile: Profile) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{profile.script}]+", ""))


def is_sentence(text: Column, profile: Profile) -> Column:
    """Length and script ratio within the profile's bounds."""
    n = F.length(text)
    return n.between(profile.min_chars, profile.max_chars) & (script_count(text, profile) / n >= profile.min_ratio)


def clean_lemma(lemma: Column) -> Column:
    """Without a foreign gloss: what stands before the first hyphen, if at least 80 % of what follows are ASCII letters."""
    at = F.instr(lemma, "-")
    rest = F.substring(lemma, at + 1, F.length(lemma))
    gloss = (at > 0) & (rest != "") & (F.regexp_count(rest, F.lit("[A-Za-z]")) >= 0.8 * F.length(rest))
    return F.when(gloss, F.substring(lemma, F.lit(1), at - 1)).otherwise(lemma)


def fill_first(sentence: Column, word: Column, profile: Profile) -> Column:
    """The first placeholder replaced by word; a sentence without one is unchanged."""
    mark = profile.placeholder
    at = F.instr(sentence, mark)
    return F.when(at > 0, F.concat(F.substring(sentence, F.lit(1), at - 1), word, F.substring(sentence, at + len(mark), F.length(sentence)))).otherwise(sentence)


def fill_all(sentence: Column, word: Column, profile: Profile) -> Column:
    return F.replace(sentence, F.lit(profile.placeholder), word)


def character_statistics(text: Column, profile: Profile) -> dict[str, Column]:
    """Counts and the verdicts on them: characters, words between spaces, script and other non-blank characters, ratio."""
    n, script = F.length(text), script_count(text, profile)
    ratio = F.coalesce(script / F.nullif(n, F.lit(0)), F.lit(0.0))
    return {
        "n_chars": n.cast("long"),
        "n_words": F.size(F.filter(F.split(text, BLANKS), lambda w: w != "")).cast("long"),
        "n_script": script.cast("long"),
        "n_other": (n - script - F.regexp_count(text, F.lit(r"[\s\x1c-\x1f\x85\p{Z}]"))).cast("long"),
        "ratio": F.round(ratio, 6),
        "length_ok": n.between(profile.min_chars, profile.max_chars),
        "ratio_ok": ratio >= profile.min_ratio,
    }
