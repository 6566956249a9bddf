"""Runners: where the models of lenses run, and which lens runs on which.

A runner is opened before a drain and closed after it. One that can't be opened
is out of the circuit: the models it would have given raise, so that its lenses
fail and back off while the lenses of other runners go on. The default runner
has to open."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from ..sources.settings import Lens, Settings
from .models import Model


class RunnerDown(RuntimeError):
    """A runner that isn't there or couldn't be opened."""


class Runner(Protocol):
    #: Whether calls may run side by side.
    concurrent: bool

    def open(self) -> None: ...
    def model(self, name: str) -> Model:
        """The model of that name, which goes to the tasks; ``""`` is the runner's own."""

    def unknown(self, names: Iterable[str]) -> list[str]:
        """Those of the names that it has no model for."""

    def close(self) -> None: ...


@dataclass
class LocalRunner:
    """Plain functions by name; the entry ``""`` is the default."""

    models: Mapping[str, Model]
    concurrent: bool = True
    on_open: Callable[[], None] | None = None
    is_open: bool = field(default=False, init=False)

    def open(self) -> None:
        if self.on_open:
            self.on_open()
        self.is_open = True

    def model(self, name: str) -> Model:
        if name not in self.models:
            raise RunnerDown(f"no model {name!r}")
        return self.models[name]

    def unknown(self, names: Iterable[str]) -> list[str]:
        return sorted(set(names) - set(self.models))

    def close(self) -> None:
        self.is_open = False


def runner_for(settings: Settings, lens: Lens | None) -> str:
    """The runner that a lens names, or the default one."""
    return (lens.runner.strip() if lens else "") or settings.runner


def model_for(settings: Settings, lens: Lens | None, phase: str) -> str:
    """The model of a phase, ``mine`` or ``review``: a lens's own, else that of the
    settings if the lens is on the default runner, else the runner's own (``""``).
    Without a review model the settings' mining model reviews, too."""
    own = (lens.model if phase == "mine" else lens.review_model).strip() if lens else ""
    if own:
        return own
    if runner_for(settings, lens) != settings.runner:
        return ""
    return settings.mine_model if phase == "mine" else settings.review_model or settings.mine_model


def runner_names(settings: Settings, lenses: Sequence[Lens]) -> list[str]:
    """The distinct runners that the lenses need, the default one among them."""
    return sorted({settings.runner, *(runner_for(settings, x) for x in lenses)})


def model_sets(settings: Settings, lenses: Sequence[Lens]) -> dict[str, list[str]]:
    """The models named for each runner: those of the settings for the default one,
    a lens's own for the lens's; the default runner is there even without any."""
    out: dict[str, set[str]] = {settings.runner: {settings.mine_model, settings.review_model}}
    for x in lenses:
        out.setdefault(runner_for(settings, x), set()).update((x.model.strip(), x.review_model.strip()))
    return {name: sorted(found - {""}) for name, found in sorted(out.items()) if name == settings.runner or found - {""}}


def problems(runners: Mapping[str, Runner], settings: Settings, lenses: Sequence[Lens]) -> list[str]:
    """What is wrong with the runners and models that are named."""
    out = []
    for name, wanted in model_sets(settings, lenses).items():
        if name not in runners:
            out.append(f"runner {name!r}: unknown")
        else:
            out += [f"runner {name!r}: no model {m!r}" for m in runners[name].unknown(wanted)]
    return out


def _down(name: str, why: str) -> Model:
    def model(text: str) -> str:
        raise RunnerDown(f"runner {name!r}: {why}")

    return model


class RunnerSet:
    """The opened runners of one drain; a context manager."""

    def __init__(self, runners: Mapping[str, Runner], settings: Settings, lenses: Sequence[Lens]) -> None:
        self.runners, self.settings = runners, settings
        self.lenses = {x.name: x for x in lenses}
        self.opened: dict[str, Runner] = {}
        self.down: dict[str, str] = {}

    def __enter__(self) -> RunnerSet:
        for name in runner_names(self.settings, list(self.lenses.values())):
            try:
                if name not in self.runners:
                    raise RunnerDown("unknown")
                self.runners[name].open()
                self.opened[name] = self.runners[name]
            except Exception as e:  # whatever a runner raises
                self.down[name] = str(e)
        if self.settings.runner in self.down:
            self.__exit__()
            raise RunnerDown(f"runner {self.settings.runner!r}: {self.down[self.settings.runner]}")
        return self

    def __exit__(self, *_: object) -> None:
        for runner in self.opened.values():
            runner.close()
        self.opened = {}

    @property
    def concurrent(self) -> bool:
        """Whether every opened runner may be called side by side."""
        return all(r.concurrent for r in self.opened.values())

    def model(self, lens: str, phase: str = "mine") -> Model:
        """The model of a lens's phase, or one that raises if its runner is down."""
        definition = self.lenses.get(lens)
        name = runner_for(self.settings, definition)
        if name not in self.opened:
            return _down(name, self.down.get(name, "not opened"))
        try:
            return self.opened[name].model(model_for(self.settings, definition, phase))
        except RunnerDown as e:
            return _down(name, str(e))
