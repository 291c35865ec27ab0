"""robots.txt rules: the group of an agent and the longest matching pattern; allow on a tie of different patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def groups(text: str) -> list[tuple[set[str], list[tuple[bool, str]]]]:
    out, agents, rules, open_ = [], set(), [], True
    for line in text.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_:
                out.append((agents, rules))
                agents, rules, open_ = set(), [], True
            agents.add(value.lower())
        elif key in ("allow", "disallow"):
            open_ = False
            if value:
                rules.append((key == "allow", value))
    if agents:
        out.append((agents, rules))
    return out


def _matches(pattern: str, path: str) -> bool:
    end = pattern.endswith("$")
    body = ".*".join(map(re.escape, pattern.removesuffix("$").split("*")))
    return re.match(body + ("$" if end else ""), path) is not None


def allowed(text: str | None, agent: str, path: str) -> bool:
    """Rules of all groups that name the agent, else those for '*'; no rule allows. A pattern that is both allowed and
    disallowed contradicts itself, and refuses."""
    every = groups(text or "")
    name = agent.lower()
    own = [r for a, rs in every if name in a for r in rs]
    if not any(name in a for a, _ in every):
        own = [r for a, rs in every if "*" in a for r in rs]
    hits = [(p, ok) for ok, p in own if _matches(p, path)]
    longest = max((len(p) for p, _ in hits), default=0)
    yes, no = ({p for p, ok in hits if ok == said and len(p) == longest} for said in (True, False))
    return not hits or bool(yes) and not yes & no


@F.pandas_udf(BooleanType())
def robots_allowed(text: pd.Series, agent: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([allowed(t, a, p) for t, a, p in zip(text, agent, path, strict=True)])
