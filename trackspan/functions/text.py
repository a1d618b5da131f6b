"""Text columns: normalisation, word sets, keys, links and report lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import values as V
from .metrics import round1

# Everything Unicode calls white space, so that trimming and splitting are not limited to U+0020.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE_RUN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(SPACES))


def norm(c) -> Column:
    """Trimmed lower case; a missing value counts as the empty text."""
    return F.lower(strip(F.coalesce(_col(c), F.lit(""))))


def norm_upper(c) -> Column:
    return F.upper(strip(F.coalesce(_col(c), F.lit(""))))


def blank_to_null(c) -> Column:
    c = _col(c)
    return F.when(c != "", c)


def has_text(c) -> Column:
    return strip(F.coalesce(_col(c), F.lit(""))) != ""


def words(c) -> Column:
    """White-space separated words, in order."""
    return F.filter(F.split(strip(c), SPACE_RUN), lambda w: w != "")


def word_set(c, min_len: int = 0) -> Column:
    """Distinct words longer than ``min_len`` characters."""
    return F.array_distinct(F.filter(words(c), lambda w: F.length(w) > min_len))


def share_of_words(query_words, title_words) -> Column:
    """|query ∩ title| / |query|; 0 when the query has no words."""
    q, t = _col(query_words), _col(title_words)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0))


def find_pos(text, needle) -> Column:
    """Zero-based position of ``needle``, -1 when absent."""
    return F.instr(_col(text), needle if isinstance(needle, str) else _col(needle)) - 1


def name_part(c, which: int) -> Column:
    """First (1) or last (-1) word reduced to ``[a-z0-9]``. A one-word name has no last part."""
    parts = words(c)
    piece = F.regexp_replace(F.get(parts, F.lit(0)) if which == 1 else F.try_element_at(parts, F.lit(-1)),
                             "[^a-z0-9]", "")
    if which != 1:
        piece = F.when(F.size(parts) > 1, piece)
    return F.coalesce(piece, F.lit(""))


def email_candidates(query, first, last, domain: str) -> Column:
    """Texts to look for, best first: the address itself, derived addresses, the raw name."""
    q, f, l = _col(query), _col(first), _col(last)
    at = F.lit("@" + domain)
    both = (f != "") & (l != "")
    return F.array_distinct(F.array_compact(F.array(
        F.when(F.contains(q, F.lit("@")), q),
        F.when(f != "", F.concat(f, at)),
        F.when(both, F.concat(f, F.lit("."), l, at)),
        F.when(both, F.concat(f, l, at)),
        F.when(both, F.concat(f, F.lit("_"), l, at)),
        F.when(both, F.concat(F.substring(f, 1, 1), l, at)),
        q,
    )))


def is_account_id(c, variant: str = "tool") -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    test = F.lit(False)
    for prefix in V.ACCOUNT_ID_PREFIXES[variant]:
        test = test | c.startswith(prefix)
    return test


def is_ticket_key(c) -> Column:
    return F.coalesce(strip(c).rlike(V.TICKET_KEY_PATTERN), F.lit(False))


def is_bot_name(c) -> Column:
    return F.lower(F.coalesce(_col(c), F.lit(""))).rlike("|".join(V.BOT_NAME_WORDS))


def browse_url(base: str, key) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/browse/"), _col(key))


def key_list(c) -> Column:
    """``"a, b,,c"`` → ``["A", "B", "C"]``."""
    return F.filter(F.transform(F.split(_col(c), ","), norm_upper), lambda k: k != "")


def positive_or_null(c) -> Column:
    c = _col(c)
    return F.when(c > 0, c)


def truncate_text(c, limit: int = V.MAX_INPUT_CHARS) -> Column:
    return F.substring(_col(c), 1, limit)


def standard_epic_title(project, name: str = V.STANDARD_EPIC_NAME) -> Column:
    return F.concat(F.lit("("), _col(project), F.lit(f") {name}"))


def standard_epic_description(project) -> Column:
    return F.concat(F.lit("Auto-created epic for deployment & configuration tickets in "), _col(project))


def deployment_title(title, project, dev_keys) -> Column:
    """The given title, else one built from the keys; null when neither exists."""
    keys = _col(dev_keys)
    built = F.when(F.size(keys) > 0, F.concat(
        F.lit("("), _col(project), F.lit(") Deployment ticket for "), F.array_join(keys, ", ")))
    return F.coalesce(blank_to_null(title), built)


def deployment_description(description, pr_link, qa_contacts, qa_instructions, dev_keys, base: str) -> Column:
    """The parts that have text, one blank line between them."""
    keys = _col(dev_keys)

    def part(label: str, c) -> Column:
        return F.concat(F.lit(label), blank_to_null(c))

    links = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("- "), browse_url(base, k))), "\n")
    return F.concat_ws(
        "\n\n",
        blank_to_null(description),
        part("PR: ", pr_link),
        part("QA: ", qa_contacts),
        part("QA Instructions:\n", qa_instructions),
        F.when(F.size(keys) > 0, F.concat(F.lit("Related development tickets:\n"), links)),
    )


def one_decimal(c) -> Column:
    """Half-even at one decimal; a missing mean prints as ``nan``."""
    c = _col(c).cast("double")
    return F.when(c.isNull(), F.lit("nan")).otherwise(F.format_string("%.1f", round1(c)))


def report_line(name, total, resolved, avg_days, rate) -> Column:
    return F.format_string(
        "%s: total=%d, resolved=%d, avg_days=%s, rate=%s%%",
        _col(name), _col(total), _col(resolved), one_decimal(avg_days), one_decimal(rate))
