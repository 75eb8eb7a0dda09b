"""Tokens, names and scores as column expressions, and the prompt-side helpers.

A prompt is one small string, so its tokens are made on the driver; whatever
touches nodes is a column expression.  Lengths are in bytes where the rule says
so (``octet_length``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no symbols.
JUNK_NAMES = ["if", "else", "for", "while", "loop", "match", "return", "let", "unknown", "anonymous", "block", "self", "super", "crate"]
TRACE_NOISE = ["new", "get", "set", "len", "map", "iter", "into", "from", "clone", "default", "unwrap", "expect", "collect", "push", "pop", "insert", "remove", "print", "println", "format", "str", "string", "vec", "some", "none", "ok", "err"]
WEAK_VERBS = ["run", "do", "call", "exec", "handle", "process", "init", "main", "test", "apply", "update"]
CODE_EXTENSIONS = (".rs", ".go", ".py", ".ts", ".tsx", ".js", ".cpp", ".c", ".h", ".hpp")
TYPE_KINDS = ["struct", "class", "enum", "interface", "trait", "union", "type_spec", "type_item", "object", "protocol", "record", "typedef", "type_declaration"]
_TRIM = ",;\"'`()[]{}!?"


# ---------------------------------------------------------------- prompt side


def pascal(s: str) -> bool:
    s = s.strip()
    return len(s.encode()) >= 3 and s[0].isupper() and all(c.islower() or c in "0123456789" for c in s[1:])


def code_shaped(s: str) -> bool:
    """Shape of an identifier or a path: separators, snake, camel, CAPS or a source ending."""
    s = s.strip()
    if len(s.encode()) < 2:
        return False
    if any(x in s for x in ("/", "\\", "::", ".", "_")) or pascal(s):
        return True
    low = False
    for c in s:
        if c.isupper() and low:
            return True
        low = low or c.islower()
    if len(s.encode()) >= 4 and all(c.isupper() or c in "0123456789" for c in s):
        return True
    return s.lower().endswith(CODE_EXTENSIONS)


def junk_symbol(s: str) -> bool:
    s = s.strip()
    return sum(c.isalnum() for c in s) < 3 or s.lower() in JUNK_NAMES


def strong_token(t: str) -> bool:
    t = t.strip()
    return len(t.encode()) >= 3 and not junk_symbol(t) and (code_shaped(t) or len(t.encode()) >= 6)


def split_camel(s: str) -> list[str]:
    return [x for x in re.split(r"(?<=[^\W\d_A-ZÀ-ÖØ-Þ])(?=[A-ZÀ-ÖØ-Þ])", s) if x]


def token_priority(s: str) -> int:
    return 100 * code_shaped(s) + 50 * ("::" in s or "/" in s) + 20 * ("_" in s) + 10 * (len(s.encode()) >= 8)


def raw_tokens(prompt: str) -> list[str]:
    """Candidate tokens of a prompt by shape, without repeats in another case, most code-like first."""
    found: dict[str, str] = {}

    def add(s: str) -> None:
        s = s.strip().strip(_TRIM)
        if len(s.encode()) >= 2:
            found.setdefault(s.lower(), s)

    whole = prompt.strip()
    if whole and not re.search(r"\s", whole):
        add(whole)
    for word in prompt.split():
        word = re.sub(r"^[^\w:/\\.\-]+|[^\w:/\\.\-]+$", "", word)
        if "::" in word or "/" in word or "\\" in word or ("." in word and len(word.encode()) > 3):
            add(word)
            tail = [x for x in re.split(r"[:/\\.]", word) if len(x.encode()) >= 2]
            if tail:
                add(tail[-1])
    for ident in re.findall(r"\w+", prompt):
        if len(ident.encode()) < 2:
            continue
        add(ident)
        parts = [*(ident.split("_") if "_" in ident else []), *split_camel(ident)]
        for part in parts:
            if len(part.encode()) >= 3:
                add(part)
    return sorted(found.values(), key=lambda t: (-token_priority(t), -len(t.encode()), t))


def normalize_seed(query: str) -> str:
    """Without attribute wrapper and call parentheses, the part after the last ``::``."""
    q = query.strip().strip("`\"'")
    m = re.fullmatch(r"#\[(.*)\]", q)
    q = m[1] if m else q
    return re.sub(r"\(\s*\)$", "", q).rsplit("::", 1)[-1].strip()


def sanitize_symbol(s: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "_", s)


def symbol_leaf(s: str) -> str:
    return s.rsplit("::", 1)[-1]


def symbol_like(s: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)*", s.strip()))


def keywords(prompt: str, stop: tuple[str, ...] = ("the", "and", "for", "with", "that", "this", "what", "where", "how")) -> list[str]:
    """White-space words of more than two characters that look like code."""
    words = [w.strip(_TRIM + ".:") for w in prompt.split()]
    return [w for w in dict.fromkeys(words) if len(w) > 2 and w.lower() not in stop and ("::" in w or "_" in w or w[:1].isupper() or w in ("self", "func"))]


def search_regex(keyword: str) -> str:
    """Matches the words of a keyword in snake or camel form."""
    parts = [re.escape(p) for x in keyword.split("_") for p in split_camel(x)]
    return "(?i)" + "_?".join(parts)


def recency_text(seconds: int) -> str:
    for limit, unit, name in ((60, 1, ""), (3600, 60, "mins"), (86400, 3600, "hours")):
        if seconds < limit:
            return "just now" if not name else f"{seconds // unit} {name} ago"
    return f"{seconds // 86400} days ago"


def truncate_tokens(text: str, most: int) -> str:
    """At most ``most`` bytes, cut at the last line break that leaves at least half."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    cut = raw[:most].decode(errors="ignore")
    at = cut.rfind("\n")
    return cut[:at] if at > len(cut) // 2 else cut


# ---------------------------------------------------------------- column side


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def pascal_col(name: Column) -> Column:
    """``pascal`` over a column."""
    return _strip(name).rlike(r"^\p{Lu}[\p{Ll}0-9]*$") & (F.octet_length(_strip(name)) >= 3)


def code_shaped_col(name: Column) -> Column:
    """``code_shaped`` over a column; a source ending has a stop, so it needs no rule of its own."""
    s = _strip(name)
    caps = s.rlike(r"^[\p{Lu}0-9]+$") & (F.octet_length(s) >= 4)
    return (F.octet_length(s) >= 2) & (s.rlike(r"[/\\._]|::") | pascal_col(s) | s.rlike(r"(?s)\p{Ll}.*\p{Lu}") | caps)


def junk_symbol_col(name: Column) -> Column:
    """``junk_symbol`` over a column."""
    s = _strip(name)
    return (F.length(F.regexp_replace(s, r"(?U)[^\p{Alnum}]", "")) < 3) | F.lower(s).isin(*JUNK_NAMES)


def strong_token_col(token: Column) -> Column:
    """``strong_token`` over a column."""
    t = _strip(token)
    return (F.octet_length(t) >= 3) & ~junk_symbol_col(t) & (code_shaped_col(t) | (F.octet_length(t) >= 6))


def token_priority_col(token: Column) -> Column:
    """``token_priority`` over a column."""
    return (
        F.when(code_shaped_col(token), 100).otherwise(0) + F.when(token.rlike("::|/"), 50).otherwise(0)
        + F.when(token.contains("_"), 20).otherwise(0) + F.when(F.octet_length(token) >= 8, 10).otherwise(0)
    )


def split_camel_col(name: Column) -> Column:
    """``split_camel`` over a column: its parts as an array."""
    return F.filter(F.split(name, r"(?U)(?<=[\w&&[^\d_A-ZÀ-ÖØ-Þ]])(?=[A-ZÀ-ÖØ-Þ])"), lambda x: x != "")


def normalize_seed_col(query: Column) -> Column:
    """``normalize_seed`` over a column."""
    q = F.regexp_replace(_strip(query), "^[`\"']+|[`\"']+$", "")
    q = F.when(q.rlike(r"^#\[.*\]$"), F.regexp_extract(q, r"^#\[(.*)\]$", 1)).otherwise(q)
    return _strip(F.substring_index(F.regexp_replace(q, r"\(\s*\)$", ""), "::", -1))


def sanitize_symbol_col(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def symbol_leaf_col(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def symbol_like_col(name: Column) -> Column:
    return _strip(name).rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)*$")


def recency_text_col(seconds: Column) -> Column:
    """``recency_text`` over a column."""

    def ago(unit: int, name: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(f" {name} ago"))

    return F.when(seconds < 60, "just now").when(seconds < 3600, ago(60, "mins")).when(seconds < 86400, ago(3600, "hours")).otherwise(ago(86400, "days"))


def count_tokens(text: Column) -> Column:
    """The larger of sub-word tokens and characters, which is the characters."""
    return F.char_length(text)


def name_hash(name: str) -> int:
    """``h * 31 + byte`` over the bytes, modulo 2**64, as a signed number."""
    h = 0
    for b in name.encode():
        h = (h * 31 + b) % 2**64
    return h - 2**64 if h >= 2**63 else h


def name_hash_column(name: Column) -> Column:
    """``name_hash`` on the JVM: two 32-bit halves keep every product inside 64 bits."""
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(name), F.lit(1))), lambda i: F.conv(F.substring(F.hex(name.cast("binary")), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    mask = 0xFFFFFFFF

    def step(h, b):
        low = h["lo"] * 31 + b
        high = h["hi"] * 31 + F.shiftright(low, 32)
        return F.struct(F.lit(mask).bitwiseAND(high).alias("hi"), F.lit(mask).bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))
    return F.when(F.octet_length(name) == 0, F.lit(0)).otherwise(
        F.aggregate(codes, start, step, lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"]))
    )


def name_score(name: Column, token: Column) -> Column:
    """Best rule of a strong token: exact, suffix at an underscore, end, prefix, component, inside."""
    n, t = F.lower(name), F.lower(token)
    size = F.octet_length(t)
    parts = F.split(n, "[_:]")
    return (
        F.when(n == t, 100000 + 100 * F.greatest(size, F.lit(3)))
        .when((size >= 3) & F.endswith(n, F.concat(F.lit("_"), t)), 800 + 8 * size)
        .when((size >= 4) & F.endswith(n, t), 500 + 5 * size)
        .when((size >= 3) & F.startswith(n, t), 450 + 4 * size)
        .when(F.array_contains(parts, t), 400 + 4 * size)
        .when((size >= 5) & F.contains(n, t), 150 + 2 * size)
        .otherwise(0).cast("double")
    )


def path_score(path: Column, token: Column) -> Column:
    p, t = F.lower(path), F.lower(token)
    size = F.octet_length(t)
    return (
        F.when(size < 3, 0).when(F.array_contains(F.split(p, r"[/\\.\-]"), t), 80 + 2 * size).when((size >= 5) & F.contains(p, t), 25 + size).otherwise(0).cast("double")
    )


def block_score(name: Column, path: Column, token: Column) -> Column:
    return name_score(name, token) + 0.5 * path_score(path, token)


def name_hit(name: Column, token: Column, strong: bool) -> Column:
    n, t = F.lower(name), F.lower(token)
    if not strong:
        return (n == t) | ((F.octet_length(t) >= 3) & F.array_contains(F.split(n, "[_:-]"), t))
    return name_score(name, token) > 0


def path_hit(path: Column, token: Column, strong: bool) -> Column:
    p, t = F.lower(path), F.lower(token)
    whole = (F.octet_length(t) >= 3) & F.array_contains(F.split(p, r"[/\\.\-]"), t)
    return whole if not strong else path_score(path, token) > 0


def module_kw(path: Column, token: Column) -> Column:
    """10 and the length for a token in the path, 8 more for its last component."""
    p, t = F.lower(path), F.lower(token)
    last = F.contains(F.element_at(F.split(p, "/"), -1), t)
    return F.when(F.contains(p, t), 10 + F.char_length(t) + F.when(last, 8).otherwise(0)).otherwise(0)


def word_boundary(text: Column, word: str) -> Column:
    return text.rlike(rf"(?U)(?<!\w){re.escape(word)}(?!\w)")


def word_boundary_ascii(text: Column, word: str) -> Column:
    return text.rlike(rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")


def trace_noise_name(name: Column) -> Column:
    return (F.octet_length(name) < 3) | F.lower(name).isin(*TRACE_NOISE)


def junk_name(name: Column) -> Column:
    return (F.length(F.regexp_replace(name, r"(?U)[^\p{Alnum}]", "")) < 3) | F.lower(name).isin(*JUNK_NAMES)


def weak_penalty(name: Column, noise: Column) -> Column:
    return F.when(noise, 100).when(F.lower(name).isin(*WEAK_VERBS), 40).otherwise(0)


def call_target_kind(kind: Column) -> Column:
    k = F.lower(kind)
    return k.rlike("function|method|arrow") & ~k.rlike("call|impl|type|struct|class|enum|trait|interface")


def type_target_kind(kind: Column) -> Column:
    hit = F.lit(False)
    for x in TYPE_KINDS:
        hit = hit | F.contains(F.lower(kind), F.lit(x))
    return hit


def structural_mult(kind: Column, degree: Column) -> Column:
    """0 for statements, 1.5 types, 1.0 callables, 0.1 nodes without edges, 0.5 otherwise."""
    return (
        F.when(role_tier(kind) == 0, 0.0).when(type_target_kind(kind), 1.5).when(call_target_kind(kind), 1.0).when(degree == 0, 0.1).otherwise(0.5)
    )


# Kinds and their tier, the first match wins.
TIERS = (
    (0, ("if_expression", "if_statement", "if_let", "for_expression", "for_statement", "while_expression", "while_statement", "loop_expression", "match_expression", "match_arm", "return_expression", "return_statement", "let_declaration", "let_statement", "assignment_expression", "assignment_statement", "range_clause", "expression_statement")),
    (10, ("call_expression", "use_declaration", "import_statement", "import_from")),
    (30, ("mod_item", "namespace")),
    (45, ("type_alias", "using_declaration")),
    (100, ("struct", "class", "interface", "trait_item", "union_item", "enum_item", "enum", "type_spec", "type_item")),
    (90, ("function_item", "function_definition", "function_declaration", "async_function", "method_definition", "method_declaration", "method_item")),
    (70, ("impl_item", "impl_definition")),
    (50, ("const_item", "static_item", "arrow_function", "lexical_declaration", "variable_declarator", "short_var_declaration")),
    (5, ("unknown",)),
)


def role_tier(kind: Column) -> Column:
    k = F.lower(kind)
    out = F.lit(20)
    for tier, names in reversed(TIERS):
        hit = F.lit(False)
        for x in names:
            hit = hit | F.contains(k, F.lit(x))
        if tier == 10:
            hit = hit | (k == "call")
        if tier == 30:
            hit = hit | (k == "module")
        out = F.when(hit, tier).otherwise(out)
    return out


def heuristic_score(in_degree: Column, out_degree: Column, matched: Column, keyword: Column, public: Column, recency_days: Column) -> Column:
    """Fixed weights of degrees, name and keyword matches, visibility and recency."""
    fresh = F.when(recency_days <= 1, 3.5).when(recency_days <= 7, 1.8).when(recency_days <= 30, 0.6).otherwise(0.0)
    return F.when(matched, 15.0).otherwise(0.0) + F.when(keyword, 4.0).otherwise(0.0) + 2.2 * in_degree + 1.0 * out_degree + F.when(public, 3.5).otherwise(0.0) + fresh


def fan_band(fan_in: Column) -> Column:
    return F.when(fan_in == 0, "none").when(fan_in <= 3, "low").when(fan_in <= 10, "medium").when(fan_in <= 50, "high").otherwise("very high")


def block_hash(source: Column) -> Column:
    """Hash of the trimmed lines, runs of blank lines collapsed."""
    lines = F.transform(F.split(source, "\n"), lambda x: F.trim(x))
    return F.md5(F.regexp_replace(F.array_join(lines, "\n"), "\n{2,}", "\n\n"))


def block_id(path: Column, kind: Column, content_hash: Column) -> Column:
    return F.concat_ws(":", path, kind, F.substring(content_hash, 1, 8))
