"""Settings: TOML file to dataclasses, with the fingerprint of all that decides an index."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from turfspoor.functions.text import REFERENCE

STRUCTURE = "2"


def as_list(value) -> list[str]:
    """A single string is a list of one; nothing is an empty list."""
    return [] if not value else [value] if isinstance(value, str) else [str(x) for x in value]


@dataclass(frozen=True)
class Source:
    name: str
    path: str
    kind: str = "markdown"
    only: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    list_field: str = ""
    id_field: str = "id"
    title_field: str = "titel"
    text_field: str = "detail"
    status_field: str = "status"
    date_field: str = ""
    section_field: str = ""
    exclude_field: str = ""
    all_fields: bool = False
    overview: bool = True


@dataclass(frozen=True)
class Settings:
    index_path: str = "index"
    model: str = "trigram-hash"
    model_file: str = ""
    model_path: str = ""
    model_cache: str = ""
    threads: int = 0
    dim: int = 64
    mask: bool = True
    mask_titles: bool = False
    recency_bonus: float = 0.25
    recency_days: int = 730
    stemmer: str = "grof"
    snippets: bool = False
    snippet_marks: tuple[str, str] = ("[", "]")
    name_weight: float = 0.7
    siblings: int = 2
    reference_patterns: tuple[str, ...] = (REFERENCE,)
    opt_out_keys: tuple[str, ...] = ("index",)
    sources: tuple[Source, ...] = field(default=())

    def __post_init__(self):
        if self.stemmer not in ("grof", "nl", "uit"):
            raise ValueError(f"stemmer {self.stemmer!r} is not one of grof, nl, uit")
        if len(self.snippet_marks) != 2:
            raise ValueError("snippet_marks takes two strings")
        if self.siblings < 0:
            raise ValueError("siblings must not be negative")
        if self.recency_days <= 0:
            raise ValueError("recency_days must be positive")
        for p in self.reference_patterns:
            re.compile(p)
        for s in self.sources:
            if s.kind not in ("markdown", "json_lijst"):
                raise ValueError(f"unknown kind {s.kind!r} of source {s.name!r}")

    def fingerprint(self) -> str:
        """Sixteen characters over what decides the content of an index, not how it is searched."""
        decides = {k: v for k, v in asdict(self).items() if k in ("model", "model_file", "dim", "mask", "mask_titles", "stemmer", "reference_patterns", "opt_out_keys", "sources")}
        return hashlib.sha1(json.dumps([STRUCTURE, decides], sort_keys=True).encode()).hexdigest()[:16]


#: Keys of the file and the settings they set; fixed, since files are written with them.
KEYS = {"db_pad": "index_path", "model": "model", "model_bestand": "model_file", "model_pad": "model_path", "model_cache": "model_cache", "threads": "threads", "dim": "dim", "maskeer_geheimen": "mask", "maskeer_titels": "mask_titles", "actualiteit_bonus": "recency_bonus", "actualiteit_dagen": "recency_days", "stemmer": "stemmer", "snippets": "snippets", "snippet_markering": "snippet_marks", "namen_gewicht": "name_weight", "aanvullen": "siblings", "verwijzingspatronen": "reference_patterns", "optout_sleutels": "opt_out_keys"}
SOURCE_KEYS = {"naam": "name", "pad": "path", "type": "kind", "alleen": "only", "uitsluiten": "without", "lijst_veld": "list_field", "id_veld": "id_field", "titel_veld": "title_field", "tekst_veld": "text_field", "status_veld": "status_field", "datum_veld": "date_field", "sectie_veld": "section_field", "uitsluit_veld": "exclude_field", "alle_velden": "all_fields", "overzicht": "overview"}
LISTS = {"only", "without", "reference_patterns", "opt_out_keys", "snippet_marks"}


def load(path: str) -> Settings:
    """Read a settings file; paths in it are relative to the file."""
    file = Path(path)
    raw = tomllib.loads(file.read_text(encoding="utf-8"))
    put = lambda given, keys: {keys[k]: tuple(as_list(v)) if keys[k] in LISTS else v for k, v in given.items() if k in keys}
    below = lambda p: p if "://" in p or Path(p).is_absolute() else str(file.parent / p)
    sources = []
    for s in raw.get("bron", []):
        if "pad" not in s:
            raise ValueError("a source needs pad")
        values = put(s, SOURCE_KEYS)
        values.setdefault("name", values.get("kind", "bron"))
        sources.append(Source(**values | {"path": below(values["path"])}))
    values = put(raw, KEYS)
    values |= {k: below(values[k]) for k in ("index_path", "model_path", "model_cache") if values.get(k)}
    return Settings(**values, sources=tuple(sources))
