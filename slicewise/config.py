"""Profiles, shared masks files, and which masks hold."""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass, field
from pathlib import Path

import yaml

MASKS_FILE = "data-masking-policy.yml"
PROFILE_FILE = ".slicewise.yaml"


class ConfigError(ValueError):
    """A profile or masks file that can't be used."""


# ---- shared masks files


@dataclass
class MaskColumn:
    expr: str
    tags: list[str] = field(default_factory=list)


@dataclass
class MaskDatabase:
    columns: dict[str, MaskColumn]
    policies: dict[str, list[str]]  # name to tags

    def select(self, policies: list[str]) -> dict[str, str]:
        """Column to expression: those tagged for any of the policies, or all without policies."""
        for name in policies:
            if name not in self.policies:
                raise ConfigError(f"{name!r} is none of the policies in the masks file")
        tags = {t for name in policies for t in self.policies[name]}
        return {k: c.expr for k, c in self.columns.items() if not policies or tags & set(c.tags)}


def load_masks_file(path: str | Path) -> dict[str, MaskDatabase]:
    """Database id to its columns and policies. The version must be 1."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        spec = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML: {e}") from e
    if not isinstance(spec, dict):
        raise ConfigError(f"{path} is no masks file: it holds no mapping")
    if spec.get("version") != 1:
        raise ConfigError(f"{path} has version {spec.get('version')!r}; only version 1 is known")
    out = {}
    for name, db in (spec.get("databases") or {}).items():
        db = db or {}
        columns = {k: MaskColumn(str(c.get("expr", "")), list(c.get("tags") or [])) for k, c in (db.get("columns") or {}).items()}
        out[name] = MaskDatabase(columns, {k: list((p or {}).get("include_tags") or []) for k, p in (db.get("policies") or {}).items()})
    return out


def discover_masks_file(start: str | Path) -> Path | None:
    """The masks file in ``start`` or above it, up to the top of the repository."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        if (folder / MASKS_FILE).is_file():
            return folder / MASKS_FILE
        if (folder / ".git").exists():
            return None
    return None


@dataclass
class Policy:
    """Masked columns of a database; keys are table.column or schema.table.column."""

    database_id: str
    exprs: dict[str, str]

    def is_sensitive(self, schema: str, table: str, column: str) -> bool:
        wanted = (f"{schema}.{table}.{column}", f"{table}.{column}")
        return any(k in self.exprs and k.count(".") == dots for k, dots in zip(wanted, (2, 1), strict=True))

    def expressions(self) -> list[str]:
        return [f"{k}={self.exprs[k]}" for k in sorted(self.exprs)]


def load_policy(path: str | Path, database_id: str, policies: list[str]) -> Policy:
    databases = load_masks_file(path)
    if database_id not in databases:
        raise ConfigError(f"{path} knows no database {database_id!r}, only {', '.join(sorted(databases))}")
    return Policy(database_id, databases[database_id].select(policies))


@dataclass
class Resolution:
    """Which masks file and policies hold: flag, then profile, then discovery; flag policies replace the profile's."""

    flag_file: str = ""
    profile_file: str = ""
    flag_policies: list[str] = field(default_factory=list)
    profile_policies: list[str] = field(default_factory=list)
    cwd: str = ""
    disabled: bool = False

    def resolve(self) -> tuple[Path | None, list[str]]:
        if self.disabled:
            return None, []
        named = self.flag_file or self.profile_file
        path = Path(self.cwd or ".") / named if named else discover_masks_file(self.cwd or ".")
        return path, list(self.flag_policies or self.profile_policies) if path else []


# ---- profiles


@dataclass
class Profile:
    connection: str = ""
    schema: str = ""
    database_id: str = ""
    masks_file: str = ""
    masks: dict[str, list[str]] = field(default_factory=dict)
    extract: dict = field(default_factory=dict)
    apply: dict = field(default_factory=dict)
    path: str = ""

    @property
    def folder(self) -> str:
        return str(Path(self.path).parent) if self.path else ""


def expand_env(text: str) -> str:
    """``$NAME`` and ``${NAME}`` by the environment; every name must be set."""
    names = re.compile(r"\$\{([^}]+)\}|\$([A-Za-z_]\w*)")
    unset = [m[0] for m in names.finditer(text) if not os.environ.get(m[1] or m[2])]
    if unset:
        raise ConfigError(f"not set in the environment: {', '.join(unset)}")
    return names.sub(lambda m: os.environ[m[1] or m[2]], text)


def load_profile(path: str | Path) -> Profile:
    try:
        spec = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML: {e}") from e
    known = {k: v for k, v in spec.items() if k in Profile.__dataclass_fields__ and k != "path" and v is not None}
    profile = Profile(**known, path=str(path))
    profile.connection = expand_env(profile.connection)
    return profile


def find_profile(named: str | None, cwd: str | Path = ".") -> Profile | None:
    """The named profile, or the one in the working folder."""
    if named:
        return load_profile(named)
    default = Path(cwd) / PROFILE_FILE
    return load_profile(default) if default.is_file() else None


def resolve_masks(profile: Profile | None = None, flag_file: str = "", flag_policies: list[str] | None = None, cwd: str = "", disabled: bool = False) -> list[str]:
    """Mask specs: those of the masks file, then the profile's inline policies, then its raw masks.

    An explicit masks file needs a database id; a discovered one without is
    skipped with a warning. Names asked for of which the file has none select
    nothing from it; no names select all its columns.
    """
    if disabled:
        return []
    profile = profile or Profile()
    names = list(profile.extract.get("mask_policies") or [])
    flag = str(Path(cwd or ".") / flag_file) if flag_file else ""
    path, policies = Resolution(flag, profile.masks_file, flag_policies or [], names, profile.folder or cwd).resolve()
    if flag:
        path = Path(flag)
    out: list[str] = []
    in_file: set[str] = set()
    if path and not profile.database_id:
        if flag_file or profile.masks_file:
            raise ConfigError(f"{path} can't be used: the profile names no database_id")
        warnings.warn(f"masks file {path} was found but the profile has no database_id: no masks taken from it", stacklevel=2)
    elif path:
        databases = load_masks_file(path)
        if profile.database_id not in databases:
            raise ConfigError(f"{path} knows no database {profile.database_id!r}, only {', '.join(sorted(databases))}")
        in_file = set(databases[profile.database_id].policies)
        chosen = [p for p in policies if p in in_file]
        if chosen or not policies:
            out += load_policy(path, profile.database_id, chosen).expressions()
    for name in names:
        if name in in_file:
            continue
        if name not in profile.masks:
            raise ConfigError(f"{name!r} is a policy neither of the masks file nor of the profile")
        out += profile.masks[name]
    return out + list(profile.extract.get("masks") or [])
