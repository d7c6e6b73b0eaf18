"""Settings of a run in layers, and prompt templates for extractors that call a model.

A value given in code wins over the environment, that over a ``.env`` file, that over a YAML file, that over a folder
with one file for each secret; what nobody sets has its default.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "MAPWRIGHT_"


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 8000
    chunk_overlap: int = 500
    attempts: int = 3
    fuzzy_threshold: float = 92.0
    candidate_names: int = 40
    graph_article_limit: int | None = None
    merge_companies: int = 50
    lock_ttl_s: float = 3600.0
    jobs_kept: int = 1000
    prompt_variant: str = "default"
    api_key: str | None = None


def _read_env(path: str | None) -> dict[str, str]:
    out = {}
    for line in Path(path).read_text().splitlines() if path and os.path.exists(path) else ():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def _read_yaml(path: str | None) -> dict:
    if not path or not os.path.exists(path):
        return {}
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def _typed(kind: str, value: object) -> object:
    if value is None or "None" in kind and value == "":
        return None
    for name, to in (("int", int), ("float", float)):
        if name in kind:
            return to(value)
    return str(value)


def load(*, env_file: str | None = None, yaml_file: str | None = None, secrets: str | None = None, environ: dict | None = None, **given) -> Settings:
    """Settings from all layers; a name that is no setting is an error only where it is given in code."""
    known = {f.name: str(f.type) for f in fields(Settings)}
    if odd := set(given) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
    environ = dict(os.environ) if environ is None else environ
    dotenv, yaml_values, found = _read_env(env_file), _read_yaml(yaml_file), {}
    for name, kind in known.items():
        layers = [(given, name), (environ, PREFIX + name.upper()), (dotenv, PREFIX + name.upper()), (yaml_values, name)]
        for layer, key in layers:
            if key in layer:
                found[name] = _typed(kind, layer[key])
                break
        else:
            if secrets and os.path.isfile(os.path.join(secrets, name)):
                found[name] = _typed(kind, Path(secrets, name).read_text().strip())
    return Settings(**found)


class Prompts:
    """Templates in a folder: ``<stage>/<variant>/<name>.md``. A file is read again once it has changed."""

    def __init__(self, folder: str) -> None:
        self.folder, self.known = Path(folder), {}

    def variants(self, stage: str = "extraction") -> list[str]:
        """The variants of a stage, ``default`` first, the others in order."""
        place = self.folder / stage
        names = [p.name for p in place.iterdir() if p.is_dir()] if place.is_dir() else []
        return sorted(names, key=lambda n: (n != "default", n))

    def checked(self, variant: str, stage: str = "extraction") -> str:
        """The variant, if there is such a one; else an error."""
        if variant not in self.variants(stage):
            raise ValueError(f"unknown variant of {stage}: {variant}")
        return variant

    def text(self, *names: str) -> str:
        path = self.folder.joinpath(*names)
        changed = path.stat().st_mtime_ns
        if self.known.get(path, (None,))[0] != changed:
            self.known[path] = (changed, path.read_text().strip())
        return self.known[path][1]

    def filled(self, variant: str, name: str, values: dict[str, str], stage: str = "extraction") -> str:
        """A template with its ``{name}`` places filled; doubled braces are single ones."""
        return self.text(stage, self.checked(variant, stage), f"{name}.md").format(**values)


def short_time(ts: Column) -> Column:
    """A time's text up to the second."""
    return F.substring(ts, 1, 19)
