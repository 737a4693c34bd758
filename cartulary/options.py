"""Options of a run, validated once."""

from __future__ import annotations

from dataclasses import dataclass, field

from cartulary.operators.catalog import Filters, Preferences

COMMANDS = ("copy", "move", "link", "extract", "zip", "playlist", "test", "dir2dat", "fixdat", "clean", "report")
MERGE_MODES = ("fullnonmerged", "nonmerged", "split", "merged")
DIGEST_ORDER = ("none", "crc32", "md5", "sha1", "sha256")


@dataclass(frozen=True)
class Options:
    """What to read, how to curate, what to write."""

    commands: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    catalogs: tuple[str, ...] = ()
    output: str | None = None
    template: str = "out/{type}"
    merge_mode: str = "fullnonmerged"
    merge_discs: bool = False
    combine: bool = False
    single: bool = False
    digest_min: str = "crc32"
    digest_max: str | None = None
    overwrite: bool = False
    overwrite_invalid: bool = False
    allow_incomplete: bool = False
    letter_limit: int | None = None
    letter_group: bool = False
    filters: Filters = field(default_factory=Filters)
    preferences: Preferences = field(default_factory=Preferences)

    def __post_init__(self) -> None:
        unknown = set(self.commands) - set(COMMANDS)
        if unknown:
            raise ValueError(f"unknown commands: {sorted(unknown)}")
        if len({"copy", "move", "link"} & set(self.commands)) > 1:
            raise ValueError("only one of copy, move and link")
        if {"extract", "zip"} <= set(self.commands):
            raise ValueError("extract and zip exclude each other")
        if {"extract", "zip"} & set(self.commands) and not {"copy", "move"} & set(self.commands):
            raise ValueError("extract and zip need copy or move")
        if self.merge_mode not in MERGE_MODES:
            raise ValueError(f"merge mode {self.merge_mode}")
        if self.digest_max and DIGEST_ORDER.index(self.digest_min) > DIGEST_ORDER.index(self.digest_max):
            raise ValueError("the least digest is above the most")
        if self.letter_group and not self.letter_limit:
            raise ValueError("grouped letters need a limit")
        if {"copy", "move", "link", "clean", "playlist"} & set(self.commands) and not self.output:
            raise ValueError("writing needs an output")
        if {"fixdat"} & set(self.commands) and not self.catalogs:
            raise ValueError("a fixdat needs catalogs")
