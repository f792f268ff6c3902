"""DuckDB SQL for the registered queries, built from shared WITH clauses.

It is written from the rules, not from the Spark plans: the score fold is a window
formula here, categories are joins, and so on.
"""

from __future__ import annotations

from ..functions import fixed
from ..operators import compliance as comp
from ..operators import risk
from ..sources.inventory import record_columns


#: The pattern of e-mail addresses, in SQL.
EMAIL = r"\b[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b"


def _q(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _files() -> str:
    columns = record_columns(lambda x: f"string_split({x}, '|')", lambda x: f"make_timestamp(CAST({x} AS BIGINT) * 1000000)", lambda x: f"sha256({x})")
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns) + " FROM documents"


def _like_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _mode() -> str:
    kinds = (("plain_text", fixed.TEXT_EXTENSIONS), ("document_text", fixed.DOCUMENT_EXTENSIONS), ("protected_metadata", fixed.PROTECTED_EXTENSIONS), ("archive_metadata", fixed.ARCHIVE_EXTENSIONS), ("metadata_only", fixed.METADATA_EXTENSIONS))
    return "CASE " + " ".join(f"WHEN extension IN ({_q(v)}) THEN '{k}'" for k, v in kinds) + " ELSE 'unknown' END"


def _status() -> str:
    content = _q((*fixed.TEXT_EXTENSIONS, *fixed.DOCUMENT_EXTENSIONS))
    return (
        f"CASE WHEN content_status <> '' THEN content_status WHEN extension IN ({_q(fixed.PROTECTED_EXTENSIONS)}) THEN 'protected' "
        f"WHEN extension IN ({_q(x for x in fixed.ARCHIVE_EXTENSIONS if x != '.zip')}) THEN 'protected_or_uninspectable_archive' "
        f"WHEN extension IN ({content}) THEN CASE WHEN content <> '' THEN 'scanned' ELSE 'empty_or_unreadable' END ELSE 'metadata_only' END"
    )


def _normal() -> str:
    ext = "CASE WHEN regexp_matches(lower(name), '^.+\\.[^.]+$') THEN lower(regexp_extract(name, '\\.[^.]+$')) WHEN starts_with(name, '.') THEN lower(name) ELSE '' END"
    states = "'protected', 'password_protected', 'encrypted', 'locked', 'bad_archive', 'protected_or_uninspectable_archive'"
    return (
        f"SELECT * REPLACE (status AS content_status), {_mode()} AS scan_mode, protected_flag OR status IN ({states}) AS protected "
        f"FROM (SELECT *, {_status()} AS status FROM (SELECT *, {ext} AS extension FROM files))"
    )


def _ascii(pattern: str) -> str:
    # RE2 repeats at most 1000 times: a longer lazy run is two runs
    for n in (2000, 1200):
        pattern = pattern.replace(f"[\\s\\S]{{0,{n}}}?", f"[\\s\\S]{{0,1000}}?[\\s\\S]{{0,{n - 1000}}}?")
    return pattern.replace("'", "''")


def _findings() -> str:
    # a word boundary beside a non-ASCII letter: to RE2 an underscore is the word character that such a letter is to others
    rows = [
        f"SELECT doc_id, {k} AS pos, '{kind}' AS type, '{level}' AS risk, least(len(regexp_extract_all(plain, '{'' if cased else '(?i)'}{_ascii(p)}', 0)), 10) AS count FROM plain"
        for k, (kind, level, cased, _, p) in enumerate(fixed.DETECTORS, 1)
    ]
    rows += [
        f"SELECT doc_id, {k} AS pos, '{kind}' AS type, '{level}' AS risk, CAST(regexp_matches(plain, '(?i){_ascii(p)}') AS BIGINT) AS count FROM plain"
        for k, (kind, level, p) in enumerate(fixed.CONTEXTS, len(fixed.DETECTORS) + 1)
    ]
    return "SELECT doc_id, pos, type, risk, CAST(count AS INTEGER) AS count FROM (" + " UNION ALL ".join(rows) + ") WHERE count > 0"


def _access() -> str:
    some = lambda column, words, fix="x": f"has_acl AND len(list_filter({column}, lambda x: {_like_any(f'replace(lower(x), {chr(39)}_{chr(39)}, {chr(39)} {chr(39)})' if fix else 'lower(x)', words)})) > 0"
    return (
        "SELECT doc_id, wide, writable, privileged, CASE WHEN wide THEN 20 ELSE 0 END + CASE WHEN writable THEN 15 ELSE 0 END + CASE WHEN privileged AND NOT wide THEN 5 ELSE 0 END AS acl, "
        "CASE WHEN wide THEN 1 ELSE 0 END + CASE WHEN wide AND writable THEN 1 ELSE 0 END + CASE WHEN has_acl THEN 0 ELSE 1 END AS n_issues FROM ("
        f"SELECT doc_id, has_acl, {some('principals', fixed.BROAD_PRINCIPALS, '')} AS wide, {some('permissions', fixed.WRITE_RIGHTS)} AS writable, {some('principals', fixed.PRIVILEGED_PRINCIPALS, '')} AS privileged FROM normal)"
    )


def _folds() -> str:
    weight = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.FINDING_WEIGHTS.items())
    return (
        "SELECT doc_id, greatest(sum(w), coalesce(max(floor + coalesce(later, 0)), 0)) AS fold, count(*) AS n_findings FROM ("
        f"SELECT doc_id, w, CASE risk WHEN 'CRITICAL' THEN 90 WHEN 'HIGH' THEN 70 END AS floor, sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later "
        f"FROM (SELECT *, CASE risk {weight} ELSE 5 END AS w FROM findings)) GROUP BY doc_id"
    )


def marked(text: str) -> str:
    return _like_any(f"lower({text})", fixed.PROTECTED_MARKERS)


FIRST_OF_THREE = "coalesce(nullif(content_status, ''), nullif(scan_error, ''), nullif(protection_type, ''), '')"
VIEW = f"(protected OR {marked(FIRST_OF_THREE)} OR extension IN ({_q(fixed.PROTECTED_EXTENSIONS)}))"


def _scored() -> str:
    ext = "CASE extension " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.EXTENSION_RISK.items()) + " ELSE 0 END"
    return (
        f"SELECT n.*, a.wide, a.writable, a.privileged, a.acl, a.n_issues, coalesce(fold, 0) AS fold, coalesce(n_findings, 0) AS n_findings, {VIEW} AS locked, "
        f"CAST(least(100, greatest(coalesce(fold, 0) + CASE WHEN {_like_any('lower(path)', fixed.PATH_KEYWORDS)} THEN 15 ELSE 0 END + {ext} "
        "+ CASE WHEN size > 0 AND size < 256 AND coalesce(n_findings, 0) > 0 THEN 10 ELSE 0 END + acl, "
        f"CASE WHEN protected OR {marked(FIRST_OF_THREE)} THEN 70 ELSE 0 END) + CASE WHEN source = 'smb' THEN 5 ELSE 0 END) AS INTEGER) AS score "
        "FROM normal n JOIN access a USING (doc_id) LEFT JOIN folds USING (doc_id)"
    )


LEVEL = "CASE WHEN score >= 90 THEN 'CRITICAL' WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"

CLAUSES = {
    "files": _files,
    "normal": _normal,
    "plain": lambda: "SELECT doc_id, regexp_replace(content, '[^\\x00-\\x7F]', '_', 'g') AS plain FROM files",
    "findings": _findings,
    "access": _access,
    "folds": _folds,
    "scored": _scored,
    "risk": lambda: f"SELECT *, {LEVEL} AS level FROM scored",
    "types": lambda: "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, v in fixed.CATEGORY_OF_TYPE.items() for c in v) + ") t(type, category)",
    "pathwords": lambda: "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, v in fixed.CATEGORY_OF_PATH for c in v) + ") t(word, category)",
    "weights": lambda: "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in fixed.CATEGORY_WEIGHTS.items()) + ") t(category, weight)",
    "frameworks": lambda: "SELECT * FROM (VALUES " + ", ".join(f"('{f[0]}', '{c}')" for f in fixed.FRAMEWORKS for c in f[2]) + ") t(framework, category)",
    "categories": lambda: (
        "SELECT DISTINCT doc_id, category FROM findings JOIN types USING (type) UNION "
        "SELECT doc_id, category FROM normal JOIN pathwords ON contains(lower(name || ' ' || path || ' ' || share || ' ' || extension), word)"
    ),
    "matches": lambda: (
        "SELECT doc_id, framework, count(m.category) AS n, max(coalesce(weight, 0)) AS strongest, string_agg(m.category, ',' ORDER BY m.category) AS matched "
        "FROM (SELECT DISTINCT doc_id, framework FROM categories, frameworks) p "
        "LEFT JOIN (SELECT doc_id, framework, c.category FROM categories c JOIN frameworks USING (category)) m USING (doc_id, framework) LEFT JOIN weights w ON w.category = m.category "
        "JOIN access USING (doc_id) GROUP BY doc_id, framework, wide, writable "
        f"HAVING count(m.category) > 0 OR (framework IN ({_q(comp.BY_EXPOSURE)}) AND (wide OR writable))"
    ),
    "evidences": lambda: (
        "SELECT m.doc_id, m.framework, coalesce(sum(points) FILTER (m.n = 0 OR EXISTS (SELECT 1 FROM types t JOIN frameworks f USING (category) WHERE t.type = x.type AND f.framework = m.framework)), 0) AS points "
        "FROM matches m LEFT JOIN (SELECT doc_id, type, CASE risk WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 9 ELSE 4 END + least(count - 1, 4) AS points FROM findings) x ON x.doc_id = m.doc_id "
        "GROUP BY m.doc_id, m.framework"
    ),
    "parts": lambda: (
        "SELECT doc_id, framework, n, matched, wide, writable, "
        "CAST(round_even(least(score, 90) * CAST(0.35 AS DOUBLE), 0) AS INTEGER) AS base, "
        "CAST(CASE WHEN n = 0 THEN 8 ELSE least(strongest + least((n - 1) * 3, 9), 30) END AS INTEGER) AS data, "
        "CAST(least(points, 25) AS INTEGER) AS evidence, "
        "CAST(least(least(round_even(acl * CAST(0.35 AS DOUBLE), 0), 12) + CASE WHEN wide THEN 8 ELSE 0 END + CASE WHEN writable THEN 5 ELSE 0 END, 20) AS INTEGER) AS exposure, "
        f"CAST(least(CASE WHEN {_like_any('lower(path)', comp.BUSY_PLACES)} THEN 5 ELSE 0 END + CASE WHEN extension IN ({_q(comp.EXPORT_EXTENSIONS)}) THEN 5 ELSE 0 END + CASE WHEN is_hidden OR is_system THEN 2 ELSE 0 END, 10) AS INTEGER) AS location, "
        "CASE WHEN protected OR contains(lower(content_status), 'encrypted') THEN -5 ELSE 5 END AS protection "
        "FROM matches JOIN evidences USING (doc_id, framework) JOIN (SELECT * EXCLUDE (wide, writable), wide, writable FROM risk) USING (doc_id)"
    ),
    "told": lambda: _told(),
    "advised": lambda: _advised(),
    "evaluated": lambda: f"SELECT *, greatest(1, least(100, base + data + evidence + exposure + location + protection)) AS compliance_score, {_control()} AS control FROM parts",
}

NEEDS = {
    "normal": ["files"], "plain": ["files"], "findings": ["plain"], "access": ["normal"], "folds": ["findings"], "scored": ["normal", "access", "folds"],
    "risk": ["scored"], "categories": ["findings", "types", "normal", "pathwords"], "matches": ["categories", "frameworks", "weights", "access"],
    "evidences": ["matches", "findings", "types", "frameworks"], "parts": ["matches", "evidences", "risk"], "evaluated": ["parts"], "told": ["risk", "findings"], "advised": ["risk", "findings"],
}


def _told() -> str:
    risky = [k for k, v in fixed.EXTENSION_RISK.items() if v > 0]
    lines = (
        ("'sensitive word in the path'", _like_any("lower(path)", fixed.PATH_KEYWORDS)), ("'extension ' || extension", f"extension IN ({_q(risky)})"),
        ("'small file with findings'", "size > 0 AND size < 256 AND n_findings > 0"), ("'broad access'", "acl > 0 AND wide"), ("'broad write access'", "acl > 0 AND wide AND writable"),
        ("'protected or unreadable'", f"protected OR {marked(FIRST_OF_THREE)}"), ("'on a network share'", "source = 'smb'"),
    )
    return "SELECT doc_id, pos AS place, replace(type, '_', ' ') || ' (' || count || ')' AS reason FROM findings" + "".join(
        f" UNION ALL SELECT doc_id, {1000 + k}, {text} FROM risk WHERE {when}" for k, (text, when) in enumerate(lines)
    )


def _advised() -> str:
    """What each finding and rule advises, in order; a text that comes again counts once, at its first place."""
    first = " ".join(f"WHEN regexp_matches(type, '{pattern}') THEN [{_q(texts)}]" for pattern, texts in risk.ADVICE)
    severe = "CASE WHEN risk IN ('CRITICAL', 'HIGH') THEN 'block movement until the owner confirms' ELSE 'watch where it moves' END"
    rules = (
        ("add the path to the data-loss policy", _like_any("lower(path)", fixed.PATH_KEYWORDS)), ("review groups and share permissions", "acl > 0"),
        ("ask the owner for a readable copy", f"protected OR {marked(FIRST_OF_THREE)}"), ("review the share", "source = 'smb'"),
    )
    return (
        f"SELECT doc_id, advice, min(place) AS place FROM (SELECT doc_id, unnest(texts) AS advice, pos * 10 + generate_subscripts(texts, 1) AS place FROM (SELECT doc_id, pos, CASE {first} ELSE [{_q(risk.GENERAL)}, {severe}] END AS texts FROM findings)"
        + "".join(f" UNION ALL SELECT doc_id, '{text}', {100000 + k} FROM risk WHERE {when}" for k, (text, when) in enumerate(rules))
        + ") GROUP BY doc_id, advice"
    )


def _control() -> str:
    out = "CASE "
    has = lambda c: f"list_contains(string_split(coalesce(matched, ''), ','), '{c}')"
    for name, _, _, controls in fixed.FRAMEWORKS:
        for key, when in (
            ("exposure", "(wide OR writable)"), ("phi", has("phi")), ("cardholder_data", has("pci_payment")),
            ("access", f"({has('credentials_secrets')} OR {has('identity_access')})"),
        ):
            if controls.get(key):
                out += f"WHEN framework = '{name}' AND {when} THEN '{controls[key]}' "
        out += f"WHEN framework = '{name}' AND n > 0 THEN '{next(iter(controls.values()))}' "
    return out + "ELSE 'Compliance Exposure Risk' END"


def sql(body: str, *clauses: str, more: dict[str, str] | None = None) -> str:
    """``body`` under the WITH clauses it needs, in order."""
    found: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in found:
            found.append(name)

    for c in clauses:
        add(c)
    parts = [f"{c} AS MATERIALIZED ({CLAUSES[c]()})" for c in found] + [f"{k} AS ({v})" for k, v in (more or {}).items()]
    return f"WITH {', '.join(parts)} {body}"


DEPARTMENT = (
    "coalesce(replace(list_filter(string_split(path, '/'), lambda p: p <> '' AND " + _like_any("lower(p)", [d.lower() for d in fixed.DEPARTMENTS]) + ")[1], '_', ' '), "
    "nullif(share, ''), list_filter(string_split(path, '/'), lambda p: p <> '')[-3], nullif(source, ''), '-')"
)
FOLDER = (
    "CASE WHEN share <> '' THEN share || '/' || coalesce(nullif(array_to_string(list_filter(string_split(path, '/'), lambda p: p <> '')[-3:-2], '/'), ''), 'root') "
    "ELSE array_to_string(list_filter(string_split(path, '/'), lambda p: p <> '')[-3:-2], '/') END"
)
HEAT = "coalesce(nullif(share, ''), list_filter(string_split(path, '/'), lambda p: p <> '')[-2], nullif(source, ''))"
KEY = "lower(source || '|' || share || '|' || path)"
PLAN = {n: " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in risk.PLAN.items()) for i, n in enumerate(("status", "owner", "sla"))}


def contextual(words: dict[str, tuple[str, ...]], longest: int, least: int, most: int, clip: int, columns: str = "DISTINCT doc_id, type, sample") -> str:
    """Values that follow a context word: up to 20 in a text, cut at a bar, redacted, ten distinct ones."""
    from ..functions.validators import PLACEHOLDERS

    quoted = lambda x: "".join("\\" + c if c in "\\.^$|()[]{}*+?-/" else c for c in x).replace("'", "''")
    tables = []
    for kind, list_of in words.items():
        anyone = "|".join(quoted(x) for x in sorted(set(list_of), key=len, reverse=True))
        # the character that ends the word is the value's first, or one of the marks before it
        pattern = rf"(?i)(?:^|[^A-Za-z0-9_])(?:{anyone})([^A-Za-z0-9_\r\n;][^\r\n;]{{0,{longest + 40}}})"
        tables.append(f"SELECT doc_id, '{kind}' AS type, list_transform(regexp_extract_all(content, '{pattern}', 1), lambda x: regexp_replace(x, '^ *(?:[:=,-]|is\\b)? *', '')) AS raw FROM files")
    return rf"""
        SELECT {columns} FROM (
            SELECT doc_id, type, unnest(list_distinct(list_transform(list_filter(list_transform(list_filter(list_transform(raw, lambda x: trim(substr(x, 1, {longest}), chr(9) || ' :=-,')), lambda x: x <> '')[1:20],
                lambda x: trim(split_part(x, '|', 1), ' :=,-')), lambda x: length(trim(regexp_replace(x, '\s+', ' ', 'g'))) BETWEEN {least} AND {most} AND lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) NOT IN ({_q(PLACEHOLDERS)})),
                lambda x: CASE WHEN length(trim(regexp_replace(substr(x, 1, {clip}), '\s+', ' ', 'g'))) <= 6 THEN '***' ELSE left(trim(regexp_replace(substr(x, 1, {clip}), '\s+', ' ', 'g')), 3) || '***' || right(trim(regexp_replace(substr(x, 1, {clip}), '\s+', ' ', 'g')), 2) END))[1:10]) AS sample
            FROM ({" UNION ALL ".join(tables)})
        )
    """
