"""Text: words, trimming, similarity, edit-distance normalisation, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import params

NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
HAS_CONTENT = r"[\p{L}\p{N}\p{S}]"
CJK = r"[\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"


SHIELD = "\ue000"  # private-use stand-in for the apostrophe


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def word_set(text: Column) -> Column:
    """Distinct lower-case words; marks stay inside their word."""
    return F.array_distinct(_words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")),
                      F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s words found in ``b``; 0 when ``a`` is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")),
                      F.lit(0.0))


def trim_blank(text: Column) -> Column:
    """Trim spaces and tabs but not line breaks."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\p{Zs}\t]+", ""), r"[\p{Zs}\t]+$", "")


def is_punctuation_only(text: Column) -> Column:
    trimmed = trim_blank(text)
    return (trimmed != F.lit("")) & ~trimmed.rlike(HAS_CONTENT)


def is_blank(text: Column) -> Column:
    return trim_blank(text) == F.lit("")


def is_cjk(text: Column) -> Column:
    """More than a third of the code points lie in the CJK, kana or Hangul ranges."""
    total = F.length(text)
    other = F.length(F.regexp_replace(text, CJK, ""))
    return (total - other) > F.floor(total / 3)


def normalize_for_wer(text: Column) -> Column:
    """Lower case, punctuation except the apostrophe to blanks, blanks collapsed."""
    shielded = F.translate(F.lower(text), "'", SHIELD)
    spaced = F.translate(F.regexp_replace(shielded, r"\p{P}", " "), SHIELD, "'")
    return F.trim(F.regexp_replace(spaced, r"[\p{Zs}\t]+", " "))


def wer_tokens(normalized: Column, cjk: Column) -> Column:
    """Words, or single characters for CJK; empty text gives an empty array."""
    chars = F.split(F.regexp_replace(normalized, " ", ""), "")
    return F.array_remove(F.when(cjk, chars).otherwise(F.split(normalized, " ")), "")


def edit_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance of two token arrays by anti-diagonals: a cell needs the two diagonals before its own only, so
    each diagonal is one ``transform``, and the work is the number of cells."""
    n, m = F.size(ref), F.size(hyp)

    def diagonal(state: Column, d: Column) -> Column:
        before, now, base, first = (state[c] for c in ("before", "now", "base", "first"))

        def cell(i: Column) -> Column:      # of the first i and the first d - i tokens
            changed = F.get(before, i - 1 - base) + F.when(F.get(ref, i - 1) == F.get(hyp, d - i - 1), 0).otherwise(1)
            longer = F.least(F.get(now, i - 1 - first), F.get(now, i - first)) + 1
            return F.when((i == 0) | (i == d), d).otherwise(F.least(changed, longer))

        begin = F.greatest(F.lit(0), d - m)
        return F.struct(now.alias("before"), F.transform(F.sequence(begin, F.least(d, n)), cell).alias("now"), first.alias("base"), begin.alias("first"))

    empty = F.struct(F.array().cast("array<int>").alias("before"), F.array(F.lit(0)).alias("now"), F.lit(0).alias("base"), F.lit(0).alias("first"))
    last = F.aggregate(F.sequence(F.lit(1), n + m), empty, diagonal, lambda state: F.element_at(state["now"], 1))
    return F.when(n + m == 0, 0).otherwise(last)


def sanitize_filename(name: Column) -> Column:
    return F.translate(name, "/:\x00", "")


def trailing_index(label: Column) -> Column:
    return F.regexp_extract(label, r"(\d+)$", 1).try_cast("bigint")


def is_unknown(label: Column) -> Column:
    return label.endswith(params.UNKNOWN)


def with_source_prefix(speaker: Column, source: Column) -> Column:
    """``Speaker 1`` on a known channel becomes ``Local Speaker 1`` / ``Remote Speaker 1``; idempotent."""
    side = F.when(source == "local", "Local ").when(source == "remote", "Remote ")
    named = F.when((speaker == "") | (speaker == params.UNKNOWN), F.lit(params.UNKNOWN)).otherwise(speaker)
    done = speaker.startswith("Local ") | speaker.startswith("Remote ") | side.isNull()
    return F.when(done, speaker).otherwise(F.concat(side, named))


def resolve_locale(language: Column) -> Column:
    """``pt_br`` -> ``pt-BR``; a bare code takes its default region."""
    norm = F.regexp_replace(trim_blank(language), "_", "-")
    parts = F.filter(F.split(norm, "-"), lambda p: p != F.lit(""))

    def cased(part: Column, i: Column) -> Column:
        script = (F.length(part) == 4) & part.rlike(r"^\p{L}{4}$")
        return (F.when(i == 0, F.lower(part))
                .when(script, F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substring(part, 2, 3))))
                .otherwise(F.upper(part)))

    regions = F.create_map(*[F.lit(x) for pair in params.DEFAULT_REGION.items() for x in pair])
    return (F.when(norm.contains("-"), F.array_join(F.transform(parts, cased), "-"))
            .otherwise(F.coalesce(F.try_element_at(regions, F.lower(norm)), norm)))
