"""Configuration: options from a file and from the caller, which wins; a cascade of root, module and pass."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from arborql.functions.text import re_check, with_environment


class PrefixMatcher:
    """ST11: whole names from unambiguous prefixes. A name that is a prefix of another is ambiguous, itself included;
    so is one put in first."""

    def __init__(self, names: list[str]):
        self.names = list(dict.fromkeys(n for n in names if n))

    def match(self, prefix: str) -> str | None:
        if not prefix:
            return None
        hits = [n for n in self.names if n.startswith(prefix)]
        return hits[0] if len(hits) == 1 else None


@dataclass(frozen=True)
class EngineConfig:
    module: str | None = None
    pass_index: int | None = None
    min_acl: str = "public"
    include_globs: list[str] = field(default_factory=list)
    exclude_globs: list[str] = field(default_factory=list)
    exclude_names: list[str] = field(default_factory=list)
    include_spi: bool = False
    skip_undocumented: bool = False
    skip_undocumented_override: bool = False
    hide_language: str | None = None
    languages: list[str] = field(default_factory=lambda: ["en"])
    products: list[str] = field(default_factory=list)
    child_item_style: str = "nested"
    custom_groups: list[dict] = field(default_factory=list)
    modules: list[dict] = field(default_factory=list)

    def __post_init__(self):
        for p in self.exclude_names:
            re_check(p)
        if self.child_item_style not in ("nested", "nested_separate_types", "separate"):
            raise ValueError(f"child_item_style {self.child_item_style}")

    def cascade(self) -> list[EngineConfig]:
        """One configuration per pass: a pass's options over its module's over the root's."""
        out = []
        for m in self.modules or [{}]:
            own = replace(self, modules=[], **{k: v for k, v in m.items() if k != "passes"})
            for k, p in enumerate(m.get("passes") or [{}]):
                out.append(replace(own, **({"pass_index": k} if m.get("passes") else {}), **p))
        return out


def parse(text: str, given: dict | None = None, env: dict[str, str] | None = None) -> EngineConfig:
    """SRC17: YAML or JSON text, options of any unique prefix, with ``given`` over it; 'no_x' unsets x."""
    text = with_environment(text, env or {})
    try:
        data = json.loads(text or "{}")
    except ValueError:
        import yaml

        data = yaml.safe_load(text) or {}
    names = [f.name for f in fields(EngineConfig)]
    match = PrefixMatcher(names)

    def named(options: dict) -> dict:
        out = {}
        for k, v in options.items():
            k = k.replace("-", "_").lstrip("_")
            no = k.startswith("no_") and k not in names
            full = k[3:] if no else k
            full = full if full in names else match.match(full)
            if full is None:
                raise ValueError(f"option {k}: unknown or ambiguous")
            out[full] = (not v) if no else v
        return out

    return EngineConfig(**(named(data) | named(given or {})))
