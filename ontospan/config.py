"""Domains of the data model and run settings."""

from __future__ import annotations

import os
from dataclasses import dataclass

# The type, flag and code system names of the data model.
DIAGNOSIS, DRUG, SYMPTOM, TEST_NAME, TEST_RESULT = "CHẨN_ĐOÁN", "THUỐC", "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM"
TYPES = (SYMPTOM, TEST_NAME, TEST_RESULT, DIAGNOSIS, DRUG)
CODED = (DIAGNOSIS, DRUG)
ASSERTED = (SYMPTOM, DIAGNOSIS, DRUG)
FLAGS = ("isNegated", "isFamily", "isHistorical")
LONG_LINE = 300


def env(*names: str, default: str = "") -> str:
    """The first of several environment variables that isn't blank."""
    return next((v for n in names if (v := os.environ.get(n, "").strip())), default)


def flag(*names: str, default: bool = False) -> bool:
    """A variable as a truth value: 1, true, yes and on are true, other values false."""
    raw = env(*names)
    return raw.lower() in ("1", "true", "yes", "on") if raw else default


def number(*names: str, default: float) -> float:
    """A variable as a number; the default where it is none."""
    try:
        return type(default)(env(*names) or default)
    except ValueError:
        return default


def input_folder(root: str) -> str:
    """The folder `input` of a root, or `test_inputs` where that isn't there."""
    first = os.path.join(root, "input")
    return first if os.path.isdir(first) else os.path.join(root, "test_inputs")


@dataclass(frozen=True)
class Settings:
    """Run settings; secrets come from the environment alone."""

    chunk_chars: int = 650
    chunk_load: int = 22
    lookup_limit: int = 5
    repair_empty_candidates: bool = True
    proposer: str = "lexicon"

    @staticmethod
    def from_env() -> Settings:
        d = Settings()
        return Settings(
            chunk_chars=number("ONTOSPAN_CHUNK_CHARS", default=d.chunk_chars), chunk_load=number("ONTOSPAN_CHUNK_LOAD", default=d.chunk_load), lookup_limit=number("ONTOSPAN_LOOKUP_LIMIT", default=d.lookup_limit),
            repair_empty_candidates=flag("ONTOSPAN_REPAIR", default=d.repair_empty_candidates), proposer=env("ONTOSPAN_PROPOSER", default=d.proposer),
        )
