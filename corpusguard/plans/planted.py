"""Made-up tokens for the registered queries, put together when they run.

No text of the driver's tables holds a token of any rule, so the queries put one into
some of them: a line with a random string of a rule's format. Nothing here is, or is
stored as, a credential. The same lines are rows of the SQL, with the places that the
rules' own patterns say.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.operators.rules import ENTROPY_ABOVE, GENERIC, GENERIC_RULE, LEAST_DIGITS, RULES, SERVICE_ACCOUNT, Rule
from corpusguard.operators.scan import shannon_entropy

#: Draws for a line, of which most fit; more mean that a rule's format cannot be drawn.
DRAWS = 1000
#: Texts whose doc_id leaves a remainder below the number of rules get that rule's token.
SLOTS, VARIANTS = 97, 3
CONTEXT = "value"
#: Tokens that are of two formats at once, by the rule that they are made for.
BOTH = {"openssh_private_key": ("private_key_pem",), SERVICE_ACCOUNT: ("private_key_pem",)}


@dataclass(frozen=True)
class Planted:
    """A line for the texts of a slot and variant, and the findings in it."""

    slot: int
    variant: int
    line: str
    found: tuple[tuple[str, int, int, str | None], ...]  # rule, start, end, context

    @property
    def redacted(self) -> str:
        """The line with the span that begins first, and of those the longest, replaced."""
        rule, start, end, _ = min(self.found, key=lambda x: (x[1], -x[2], [r.rule_id for r in RULES].index(x[0]) if x[0] != GENERIC else 0))
        return f"{self.line[:start]}[REDACTED:{rule}]{self.line[end:]}"


def _characters(items: list) -> str:
    out = ""
    for kind, value in items:
        if str(kind) == "LITERAL":
            out += chr(value)
        elif str(kind) == "RANGE":
            out += "".join(map(chr, range(value[0], value[1] + 1)))
        else:  # of the categories only digits and white space occur
            out += string.digits if "DIGIT" in str(value) else " "
    return out


def _drawn(parsed, rng: random.Random) -> str:
    """A random string of a parsed pattern; look-around is left to chance."""
    out = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            out.append(chr(value))
        elif name == "IN":
            out.append(rng.choice(_characters(value)))
        elif name == "BRANCH":
            out.append(_drawn(rng.choice(value[1]), rng))
        elif name == "SUBPATTERN":
            out.append(_drawn(value[3], rng))
        elif name == "MAX_REPEAT":
            least, most, inner = value
            for _ in range(least if least == 0 else min(int(most), least + 11)):
                out.append(_drawn(inner, rng))
    return "".join(out)


def _token(rule: Rule, rng: random.Random) -> str:
    if rule.rule_id == SERVICE_ACCOUNT:
        key = "-----BEGIN " + "PRIVATE KEY-----" + "".join(rng.choices(string.ascii_letters, k=20))
        return '{"type": "service_account", "project_id": "p%d", "private_key": "%s", "client_email": "a@b.iam.gserviceaccount.com"}' % (rng.randrange(99), key)
    return _drawn(re._parser.parse(rule.pattern.pattern, rule.pattern.flags), rng)


def _findings(rule: Rule, line: str) -> tuple[tuple[str, int, int, str | None], ...] | None:
    """Where the patterns match, if those do that should and each once."""
    out = []
    for other in RULES:
        places = [m.span(other.pattern.groups) for m in other.pattern.finditer(line)]
        if len(places) != (other is rule or other.rule_id in BOTH.get(rule.rule_id, ())):
            return None
        if places:
            whole = (line.index("{"), line.rindex("}") + 1) if other.rule_id == SERVICE_ACCOUNT else places[0]
            out.append((other.rule_id, *whole, None))
    if rule.made_up is not None and rule.made_up.search(line):
        return None
    if rule is GENERIC_RULE:
        found = [m for m in rule.pattern.finditer(line) if sum(c.isdigit() for c in m[0]) >= LEAST_DIGITS and shannon_entropy(m[0]) > ENTROPY_ABOVE]
        return ((GENERIC, *found[0].span(), CONTEXT),) if len(found) == 1 else None
    return tuple(out)


@lru_cache(maxsize=1)
def planted_lines() -> tuple[Planted, ...]:
    out = []
    for slot, rule in enumerate((*RULES, GENERIC_RULE)):
        for variant in range(VARIANTS):
            rng = random.Random(f"{rule.rule_id} {variant}")
            drawn = (f"{CONTEXT} = {_token(rule, rng)} ." for _ in range(DRAWS))
            fitting = next(((line, found) for line in drawn if (found := _findings(rule, line)) is not None), None)
            if fitting is None:
                raise ValueError(f"no line has a token of {rule.rule_id} alone")
            out.append(Planted(slot, variant, *fitting))
    return tuple(out)


def with_tokens(docs: DataFrame) -> DataFrame:
    """The documents, some with a line more; null texts stay null."""
    lines = docs.sparkSession.createDataFrame([(p.slot, p.variant, p.line) for p in planted_lines()], "_slot long, _variant long, _line string")
    placed = docs.withColumns({"_slot": F.col("doc_id") % SLOTS, "_variant": F.floor(F.col("doc_id") / SLOTS) % VARIANTS})
    more = F.when(F.col("_line").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), "_line", F.lit("\n")))
    return placed.join(F.broadcast(lines), ["_slot", "_variant"], "left").withColumn("text", more).select(*docs.columns)


def _quoted(value: str | int | None) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def lines_sql() -> str:
    """``lines(slot, variant, line, redacted, n)`` and ``texts``: the documents with them."""
    rows = ", ".join(f"({p.slot}, {p.variant}, {_quoted(p.line)}, {_quoted(p.redacted)}, {len(p.found)})" for p in planted_lines())
    return f"""lines(slot, variant, line, redacted, n) AS (VALUES {rows}),
texts AS (
  SELECT d.*, l.slot, l.variant, l.redacted, l.n, CASE WHEN line IS NULL THEN text ELSE text || chr(10) || line || chr(10) END AS whole
  FROM documents d LEFT JOIN lines l ON d.doc_id % {SLOTS} = l.slot AND (d.doc_id // {SLOTS}) % {VARIANTS} = l.variant
)"""


def findings_sql(fingerprint) -> str:
    """``found``: the findings in the lines, with the fingerprint of each value."""
    rows = ", ".join(
        "(" + ", ".join(map(_quoted, (p.slot, p.variant, rule, start, end, context, fingerprint(p.line[start:end])))) + ")" for p in planted_lines() for rule, start, end, context in p.found
    )
    return f"found(slot, variant, rule_id, a, b, context_name, fingerprint) AS (VALUES {rows})"
