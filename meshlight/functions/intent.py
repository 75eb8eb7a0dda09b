"""Request-side text rules: intents, receipts, proofs, tiers and steps."""

from __future__ import annotations

import re

# Words of a request and the goal they mean.
INTENTS = {
    "callers": "trace", "callees": "trace", "calls": "trace", "usage": "trace", "impact": "trace", "blast": "trace", "who_calls": "trace", "find": "find", "where": "find", "define": "find",
    "definition": "find", "locate": "find", "arch": "arch", "architecture": "arch", "overview": "arch", "map": "arch", "summary": "arch", "context": "context", "explain": "context",
}


def intent_key(text: str) -> str:
    """The goal of a word or phrase: the table, then what it contains."""
    t = text.strip().lower().replace("-", "_").replace(" ", "_")
    return INTENTS.get(t) or next((g for w, g in INTENTS.items() if w in t), "context")


def ask_route(question: str) -> tuple[str, str]:
    """(goal, subject) of a free question: the last code-like word is the subject."""
    from .text import code_shaped, raw_tokens

    subject = next((t for t in raw_tokens(question) if code_shaped(t)), "")
    return intent_key(question), subject


def ask_remap(arguments: dict) -> dict:
    """Facade arguments under their own names."""
    names = {"q": "query", "question": "query", "symbol": "query", "path": "scopes", "scope": "scopes", "limit": "max_results", "budget": "max_tokens"}
    out = {names.get(k, k): v for k, v in arguments.items() if v is not None}
    if isinstance(out.get("scopes"), str):
        out["scopes"] = (out["scopes"],)
    return out


def prompt_intent(prompt: str) -> str:
    """search for ``search:`` or a quoted prompt, meta, location, or normal."""
    p = prompt.strip().lower()
    if p.startswith("search:") or re.fullmatch(r"\"[^\"]+\"|'[^']+'", p):
        return "search"
    if re.match(r"(help|what can you|list tools|status)\b", p):
        return "meta"
    return "location" if re.match(r"(where|locate|find the file)\b", p) else "normal"


def fragment(short: str, longer: list[str]) -> bool:
    """A snake piece of a longer token."""
    s = short.lower()
    return any(s != x.lower() and s in x.lower().split("_") for x in longer)


def line_cost(name: str, file: str, lang: str, cluster: str) -> int:
    return 8 + len(name) + len(file) + len(lang) + len(cluster) + 12


def path_affinity(module: str, path: str) -> int:
    """Components of a dotted module that end a path, counted from the last."""
    want, have = re.split(r"[./:]+", module.strip(".")), re.split(r"[/.]", re.sub(r"\.[^./]+$", "", path))
    n = 0
    while n < min(len(want), len(have)) and want[-1 - n] == have[-1 - n]:
        n += 1
    return n


def ts_paths(config: dict, spec: str) -> list[str]:
    """Candidates of an import under the ``paths`` aliases of a compiler configuration."""
    options = config.get("compilerOptions", {})
    base = options.get("baseUrl", ".").rstrip("/")
    out = []
    for pattern, targets in options.get("paths", {}).items():
        head, star, tail = pattern.partition("*")
        if spec == pattern or (star and spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail)):
            middle = spec[len(head) : len(spec) - len(tail)] if star else ""
            out += [re.sub(r"(^|/)(\./)+", r"\1", f"{base}/{t.replace('*', middle)}") for t in targets]
    return out


def mdef_parse(call: str) -> tuple[str, str] | None:
    """(export, target) of the arguments of a ``def("name", &target)`` call."""
    m = re.search(r"def\(\s*\"([^\"]+)\"\s*,\s*&?\s*([\w:]+)?", call)
    return (m[1], (m[2] or m[1]).rsplit("::", 1)[-1]) if m else None


def why_edge(kind: str, src: str, dst: str, hop: int) -> str:
    """One sentence that says why a row is there."""
    if kind in ("export", "ipc", "twin"):
        return {"export": f"{src} uses the export {dst}", "ipc": f"{src} sends the command {dst}", "twin": f"{src} and {dst} share a distinctive name"}[kind]
    return f"{src} reaches {dst} over {hop} calls" if hop > 1 else f"{src} calls {dst}"


def receipt_basis(error: bool, disambiguated: bool, located: bool, type_seed: bool, bridge: str | None) -> str:
    if error:
        return "error"
    if disambiguated:
        return "disambiguate"
    if located:
        return "location-only"
    return f"bridge-{bridge}" if bridge else "type-neighborhood" if type_seed else "bare-name"


def blast_domain(type_seed: bool, structured: bool) -> str:
    return "type_neighborhood" if type_seed and structured else "call"


def scope_frame(callers: int, callees: int, tags: list[str]) -> str:
    band = "none" if not callers else "low" if callers <= 3 else "medium" if callers <= 10 else "high" if callers <= 50 else "very high"
    return f"called by {callers}, calls {callees}, fan-in {band}" + (f" [{', '.join(tags)}]" if tags else "")


def retry_ms(elapsed_s: float) -> int:
    return 250 if elapsed_s < 2 else 1000 if elapsed_s < 10 else 3000 if elapsed_s < 60 else 10_000


def pressure_tier(free_share: float) -> str:
    return "critical" if free_share < 0.05 else "high" if free_share < 0.15 else "elevated" if free_share < 0.3 else "normal"


def edge_tier(ram_gb: float) -> dict[str, int]:
    """Threads, files and bytes of a batch by memory."""
    step = 0 if ram_gb < 8 else 1 if ram_gb < 16 else 2 if ram_gb < 32 else 3
    return {"threads": 2 << step, "files": 64 << step, "bytes": (16 << 20) << step}


def export_allows_attr(name: str) -> bool:
    return len(name) >= 8 or "_" in name


def fuzzy_best(names: list[tuple[str, float, int]], query: str) -> str | None:
    """Of (name, score, degree): exact, without case, then what contains the query."""
    q = query.lower()
    best, top = None, 0.0
    for name, score, degree in sorted(names):
        n = name.lower()
        rank = 4 if name == query else 3 if n == q else 2 if n.startswith(q) else 1 if q in n else 0
        if rank and rank * 1e9 * (rank > 2) + rank * 10 + score + degree > top:
            best, top = name, rank * 1e9 * (rank > 2) + rank * 10 + score + degree
    return best


def gnn_bucket(kind: str) -> int:
    """One of 15 buckets of kinds."""
    order = ("struct", "class", "enum", "interface", "trait", "union", "type", "function", "method", "arrow", "impl", "const", "mod", "variable")
    return next((i for i, w in enumerate(order) if w in kind.lower()), 14)
