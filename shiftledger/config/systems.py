"""Declarations of source systems: how to recognise, map and clean an export."""

from __future__ import annotations

from dataclasses import dataclass, field

from shiftledger.config import fixed_values as fv

BLANK = "Blank"


@dataclass(frozen=True)
class Rename:
    target: str
    source: str


@dataclass(frozen=True)
class Concat:
    """Join columns as text. ``whole`` columns must be integers; ``widths`` zero-pads columns."""

    target: str
    sources: tuple[str, ...]
    delimiter: str = ""
    whole: tuple[str, ...] = ()
    widths: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Slice:
    target: str
    source: str
    start: int | None = None
    end: int | None = None


@dataclass(frozen=True)
class SourceSystem:
    name: str
    header_row: int
    detect: tuple[str, ...]
    mappings: tuple = ()
    drop_rows: dict[str, object] = field(default_factory=dict)


ADP = SourceSystem(
    name="ADP",
    header_row=5,
    detect=("CO.", "PAY DATE"),
    mappings=(
        Concat("IDX", ("CO.", "FILE#"), "0", whole=("FILE#",), widths={"FILE#": 6}),
        *[Rename(target, source) for target, source in fv.ADP_RENAMES.items()],
    ),
)

TIME_AND_ATTENDANCE = SourceSystem(
    name="Time and Attendance",
    header_row=7,
    detect=("Employee", "In Punch Comment"),
    mappings=(Slice("Location", "ID", 0, 3),),
    drop_rows={"In Punch": BLANK, "Out Punch": BLANK},
)

WORKFORCE_MANAGER = SourceSystem(
    name="Workforce Manager",
    header_row=5,
    detect=("Employee", "Home Labor Category"),
    mappings=(
        Concat("ID", ("Pay Group", "Payroll File Number"), "0"),
        Rename("Location", "Pay Group"),
    ),
    drop_rows={
        "In Punch": BLANK,
        "Out Punch": BLANK,
        "Apply To": ["Sick Pay", "Vacation"],
        "ID": ["TESTEE"],
        "Employee": ["testee"],
    },
)

REGISTER_SYSTEMS = (ADP,)
PUNCH_SYSTEMS = (TIME_AND_ATTENDANCE, WORKFORCE_MANAGER)
