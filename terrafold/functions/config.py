"""Settings of a run: an argument goes before the environment, that before the default; an empty variable counts as unset."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "TERRAFOLD_"


@dataclass(frozen=True)
class Settings:
    host: str = "0.0.0.0"  # noqa: S104 - a server's default
    port: int = 5000
    backbone: str = ""
    segmenter: str = ""
    batch_size: int = 25
    min_disparity: float = 40.0
    output_dir: str = "output"

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, **arguments) -> Settings:  # noqa: ANN003
        """Arguments that are None count as not given; values from the environment are converted to the default's type; an unknown argument is an error."""
        env = os.environ if env is None else env
        known = {f.name: type(f.default) for f in fields(cls)}
        if unknown := set(arguments) - set(known):
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
        found = {n: kind(v) for n, kind in known.items() if (v := env.get(PREFIX + n.upper()))}
        return cls(**found | {n: v for n, v in arguments.items() if v is not None})
