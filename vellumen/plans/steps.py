"""A run's steps, with what each one touches."""

from __future__ import annotations

from dataclasses import asdict, dataclass

EFFECTS = ("reads_pdf", "writes_files", "calls_external_command", "calls_model_endpoint", "touches_review_inbox")


@dataclass(frozen=True)
class Step:
    step_id: str
    title: str
    reads_pdf: bool = False
    writes_files: bool = False
    calls_external_command: bool = False
    calls_model_endpoint: bool = False
    touches_review_inbox: bool = False
    enabled_for_dry_run: bool = False

    @property
    def has_side_effects(self) -> bool:
        return any(getattr(self, e) for e in EFFECTS)


STEPS = (
    Step("load_config", "Read and check the configuration", enabled_for_dry_run=True),
    Step("check_paths", "Check that all folders are below the root", enabled_for_dry_run=True),
    Step("list_inputs", "List the input files", enabled_for_dry_run=True),
    Step("split_pages", "Split files into pages", reads_pdf=True, writes_files=True),
    Step("render_pages", "Render pages", reads_pdf=True, writes_files=True, calls_external_command=True),
    Step("ask_orientation", "Ask for each page's orientation", writes_files=True, calls_model_endpoint=True),
    Step("turn_pages", "Turn or copy pages", reads_pdf=True, writes_files=True),
    Step("crop_title_blocks", "Crop turned pages", reads_pdf=True, writes_files=True, calls_external_command=True),
    Step("ask_numbers", "Ask for drawing numbers", writes_files=True, calls_model_endpoint=True),
    Step("publish", "Publish pages or send them to review", writes_files=True, touches_review_inbox=True),
    Step("write_report", "Write report and summary", writes_files=True),
)


def report(steps: tuple[Step, ...] = STEPS) -> list[dict]:
    return [asdict(s) | {"has_side_effects": s.has_side_effects} for s in steps]


def effects(steps: tuple[Step, ...] = STEPS) -> dict[str, object]:
    """Numbers of steps, and which effects a whole run would have."""
    return {"step_count": len(steps), "dry_run_enabled_step_count": sum(s.enabled_for_dry_run for s in steps), **{f"future_run_{e}": any(getattr(s, e) for s in steps) for e in EFFECTS}, "current_run_has_side_effects": any(s.has_side_effects for s in steps if s.enabled_for_dry_run)}
