"""SQL text to tokens, by one pattern."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Words that are not plain identifiers.
RESERVED = frozenset(
    """
    ALL ANALYZE AND ANY AS ASC ASYMMETRIC AUTHORIZATION BETWEEN BINARY BOTH BREADTH BY CASE CAST CHECK COLLATE COLLATION
    COLUMN COMMIT CONCURRENTLY CONFLICT CONSTRAINT CREATE CROSS CUBE CURRENT CURRENT_CATALOG CURRENT_DATE CURRENT_ROLE
    CURRENT_SCHEMA CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER DEFAULT DEFERRABLE DELETE DESC DISTINCT DO DROP ELSE END
    EXCEPT EXCLUDE EXCLUDING EXPONENTIATION FALSE FETCH FILTER FIRST FOLLOWING FOR FOREIGN FREEZE FROM FULL GRANT GROUPING
    HAVING ILIKE IN INCLUDING INITIALLY INNER INSERT INTERSECT INTERVAL INTO IS ISNULL JOIN LAST LATERAL LEADING LEFT LIKE
    LIMIT LOCAL LOCALTIME LOCALTIMESTAMP LOCKED MATERIALIZED NATURAL NEXT NO NOT NOTNULL NOWAIT NULL NULLS OF OFFSET ON ONLY
    OR ORDER ORDINALITY OTHERS OUTER OVER OVERLAPS PARTITION PLACING PRECEDING PRIMARY RECURSIVE REFERENCES RETURNING RIGHT
    ROLLBACK ROLLUP ROW ROWS SEARCH SELECT SESSION SESSION_USER SET SHARE SIMILAR SKIP SOME SYMMETRIC SYSTEM_USER TABLE
    TABLESAMPLE THEN TIES TIMESTAMP TO TRAILING TRUE UNBOUNDED UNION UNIQUE UNKNOWN UPDATE USER USING VALUES VARIADIC VERBOSE
    WHEN WHERE WINDOW WITH
    """.split()
)
_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<escape>[eE]'[^'\\]*(?:(?:''|\\.)[^'\\]*)*')
      |(?P<string>'[^']*(?:''[^']*)*')
      |(?P<name>"[^"]*(?:""[^"]*)*"|[^\W\d]\w*)
      |(?P<float>\d+\.\d*|\.\d+)
      |(?P<int>\d+)
      |(?P<param>\$\d+)
      |(?P<op>->>|\#>>|!~\*|->|\#>|\#-|@>|<@|\?\||\?&|\|\||&&|!~|~\*|!=|<>|<=|>=|==|::|[-+*/%<>=~!?:.,;()\[\]^])""",
    re.X | re.S,
)


#: A single word of more characters is an error: servers cut names at 63 bytes.
LONGEST_WORD = 1 << 20


class SqlError(ValueError):
    """Text that the dialect does not take."""


class Token(NamedTuple):
    kind: str  # the word itself if reserved, name, string, escape, int, float, param, the sign of an operator, or end
    text: str
    upper: str


def tokens(sql: str) -> list[Token]:
    """All tokens, an `end` last. GROUP BY and AT TIME ZONE are one token each."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise SqlError(f"illegal character {sql[at]!r}")
        at, kind, text = m.end(), m.lastgroup, m.group()
        if kind == "skip":
            continue
        if kind == "name" and len(text) > LONGEST_WORD:
            raise SqlError("text too long")
        upper = text.upper()
        out.append(Token(upper if kind == "name" and upper in RESERVED else text if kind == "op" else kind, text, upper))
    end = Token("end", "", "")
    merged, k = [], 0
    while k < len(out):
        words = [t.upper for t in out[k : k + 3]]
        if words[:2] == ["GROUP", "BY"]:
            merged.append(Token("GROUP BY", "GROUP BY", "GROUP BY"))
            k += 2
        elif words == ["AT", "TIME", "ZONE"]:
            merged.append(Token("AT TIME ZONE", "AT TIME ZONE", "AT TIME ZONE"))
            k += 3
        else:
            merged.append(out[k])
            k += 1
    return merged + [end]
