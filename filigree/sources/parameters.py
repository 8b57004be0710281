"""Run parameters: a typed record, read from a shared file and a personal one."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Parameters:
    """Settings with defaults for what a file leaves out; lists are pairs of numbers."""

    learning_rate: float = 0.01
    epochs: int = 20
    batch_size: int = 128
    max_degree: int = 25
    samples: tuple[int, ...] = (25, 10)
    walks: int = 20
    walk_length: int = 5
    class_weights: bool = False
    percent_train_thresh: float = 0.0
    break_training_size: float = 60.0
    geto_influence_type: str = "all"
    x_box: tuple[tuple[int, int], ...] = ()
    y_box: tuple[tuple[int, int], ...] = ()


def parsed(text: str) -> dict[str, object]:
    """'name value' lines; a leading '_' is a comment; 'a,b' is a list, and repeated names extend it."""
    out: dict[str, object] = {}
    for line in text.splitlines():
        name, _, value = line.strip().partition(" ")
        if not name or name.startswith("_") or not value:
            continue
        if "," in value:
            pair = tuple(int(x) for x in value.split(","))
            out[name] = (*out.get(name, ()), pair)  # type: ignore[misc]
        else:
            out[name] = value
    return out


def load(shared: str, personal: str = "") -> Parameters:
    """The shared settings, overridden by personal ones; values take the type of the default, unknown names are left out."""
    values, base = parsed(shared) | parsed(personal), Parameters()
    typed: dict[str, object] = {}
    for f in fields(base):
        if f.name not in values:
            continue
        value, default = values[f.name], getattr(base, f.name)
        if isinstance(default, bool):
            typed[f.name] = "True" in str(value)
        elif isinstance(default, tuple):
            typed[f.name] = value[0] if f.name == "samples" and isinstance(value, tuple) and isinstance(value[0], tuple) else value
        else:
            typed[f.name] = type(default)(value)  # type: ignore[call-arg]
    return replace(base, **typed)
