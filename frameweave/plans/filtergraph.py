"""A small filter language: ``scale=8:8,eq=brightness=0.06:contrast=0.2,invert`` becomes steps, and steps one DataFrame plan.

Pointwise steps are expressions over the same row, so Catalyst collapses a run of them into one projection; only steps that
look at neighbours or at a whole frame add a stage. Steps that change nothing are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.numeric import parse_color
from ..operators import neighborhood as H
from ..operators import pointwise as P
from ..operators import spatial as S


class FilterError(ValueError):
    """An unknown filter, or arguments that it can't take."""


@dataclass
class Clip:
    """Pixels with the size of their frames."""

    px: DataFrame
    width: int
    height: int


@dataclass(frozen=True)
class Step:
    name: str
    args: dict = field(default_factory=dict)


def _px(f: Callable[..., DataFrame], **defaults) -> Callable[[Clip, dict], Clip]:
    """A filter of pixels alone; arguments under the names that the language has for them."""

    def apply(clip: Clip, args: dict) -> Clip:
        given = {to: args.get(name, default) for name, (to, default) in defaults.items() if args.get(name, default) is not None}
        return Clip(f(clip.px, **given), clip.width, clip.height)

    return apply


def _sized(f: Callable[..., DataFrame], **defaults) -> Callable[[Clip, dict], Clip]:
    """A filter that knows the frame's size and keeps it."""

    def apply(clip: Clip, args: dict) -> Clip:
        given = {to: args.get(name, default) for name, (to, default) in defaults.items() if args.get(name, default) is not None}
        return Clip(f(clip.px, clip.width, clip.height, **given), clip.width, clip.height)

    return apply


def _length(v, whole: int) -> int | None:
    if v is None or v in (-1, -2):
        return None
    return max(1, round(whole * float(v[:-1]) / 100)) if isinstance(v, str) and v.endswith("%") else int(v)


def _scale(clip: Clip, args: dict) -> Clip:
    w, h = _length(args.get("width", args.get("w")), clip.width), _length(args.get("height", args.get("h")), clip.height)
    if w is None and h is None:
        return clip
    even = 2 if -2 in (args.get("width"), args.get("height")) else 1
    w, h = w or max(even, round(h * clip.width / clip.height / even) * even), h or max(even, round(w * clip.height / clip.width / even) * even)
    if (w, h) == (clip.width, clip.height):
        return clip
    kernel = args.get("kernel", "area")
    if kernel == "area" and clip.width % w == 0 and clip.height % h == 0:
        return Clip(S.scale_area(clip.px, clip.width // w, clip.height // h), w, h)
    if kernel not in S.SCALE_KERNELS:
        raise FilterError(f"unknown kernel {kernel!r}")
    return Clip(S.scale(clip.px, clip.width, clip.height, w, h, kernel), w, h)


def _crop(clip: Clip, args: dict) -> Clip:
    x, y = int(args.get("x", 0)), int(args.get("y", 0))
    w, h = int(args.get("width", clip.width - x)), int(args.get("height", clip.height - y))
    return clip if (x, y, w, h) == (0, 0, clip.width, clip.height) else Clip(S.crop(clip.px, x, y, w, h), w, h)


def _color(v) -> tuple[int, int, int, int]:
    return parse_color(v if v is not None else "black")


def _pad(clip: Clip, args: dict) -> Clip:
    w, h = int(args.get("width", clip.width)), int(args.get("height", clip.height))
    color = (0, 0, 0, 0) if args.get("transparent") else _color(args.get("color"))
    return Clip(S.pad(clip.px, clip.width, clip.height, w, h, color, mode=args.get("mode", "solid")), w, h)


def _rotate(clip: Clip, args: dict) -> Clip:
    turns = round(float(args.get("deg", args.get("angle", args.get("value", 0)))) / 90) % 4
    size = (clip.height, clip.width) if turns % 2 else (clip.width, clip.height)
    return clip if not turns else Clip(S.rotate(clip.px, clip.width, clip.height, 90 * turns), *size)


def _aspect(clip: Clip, args: dict) -> Clip:
    found = re.fullmatch(r"\s*([\d.]+)\s*(?:[:x/]\s*([\d.]+))?\s*", str(args.get("ratio", args.get("value", "16:9"))))
    if not found:
        raise FilterError(f"no aspect: {args}")
    x, y, w, h = S.aspect_crop(clip.width, clip.height, float(found[1]) / float(found[2] or 1))
    return Clip(S.crop(clip.px, x, y, w, h), w, h)


def _fit(clip: Clip, args: dict) -> Clip:
    w, h = int(args.get("width", clip.width)), int(args.get("height", clip.height))
    plan = S.fit_plan(clip.width, clip.height, w, h, args.get("mode", "contain"))
    scaled = _scale(clip, {"width": plan["width"], "height": plan["height"], "kernel": args.get("kernel", "nearest")})
    if plan["width"] > w or plan["height"] > h:
        return _crop(scaled, {"x": max(0, -plan["x"]), "y": max(0, -plan["y"]), "width": min(w, plan["width"]), "height": min(h, plan["height"])})
    return _pad(scaled, {**args, "width": w, "height": h, "mode": "solid"})


def _convolve(clip: Clip, args: dict, kernel: str | None = None, bias: float = 0) -> Clip:
    k = kernel or args.get("kernel", args.get("value", "sharpen"))
    if k not in H.KERNELS:
        raise FilterError(f"unknown kernel {k!r}")
    return Clip(H.convolve(clip.px, clip.width, clip.height, k, args.get("div"), args.get("bias", bias)), clip.width, clip.height)


def _eq(clip: Clip, args: dict) -> Clip:
    px = P.eq(clip.px, args.get("brightness", 0.0), args.get("contrast", 0.0), args.get("gamma", 1.0), args.get("pivot", 0.5))
    return Clip(P.hue(P.saturate(px, args.get("saturation", 1.0)), args.get("hue", 0.0)), clip.width, clip.height)


def _value(f: Callable[..., DataFrame], to: str, default, *names: str) -> Callable[[Clip, dict], Clip]:
    """A filter of one number, under any of ``names`` or given alone."""

    def apply(clip: Clip, args: dict) -> Clip:
        found = next((args[n] for n in (*names, "v", "value") if n in args), default)
        return Clip(f(clip.px, **{to: found}), clip.width, clip.height)

    return apply


def _blur(passes: int) -> Callable[[Clip, dict], Clip]:
    def apply(clip: Clip, args: dict) -> Clip:
        return Clip(H.box_blur(clip.px, clip.width, clip.height, max(1, int(args.get("radius", args.get("value", 2)))), int(args.get("steps", passes))), clip.width, clip.height)

    return apply


def _kernel(f: str) -> Callable[[Clip, dict], Clip]:
    """A step over whole frames in Arrow batches."""

    def apply(clip: Clip, args: dict) -> Clip:
        from ..operators import kernels

        return Clip(getattr(kernels, f)(clip.px, clip.width, clip.height, **{k: v for k, v in args.items() if k in ("amount", "seed", "tolerance", "color")}), clip.width, clip.height)

    return apply


REGISTRY: dict[str, Callable[[Clip, dict], Clip]] = {
    "scale": _scale, "crop": _crop, "pad": _pad, "rotate": _rotate, "aspect": _aspect, "fit": _fit,
    "flip": lambda c, a: Clip(S.flip(c.px, c.width, c.height, a.get("h", True), a.get("v", True)), c.width, c.height),
    "transpose": lambda c, a: Clip(S.transpose(c.px), c.height, c.width),
    "grayscale": _value(P.grayscale, "mode", "luma", "mode"), "sepia": _value(P.sepia, "amount", 1.0, "amount"), "invert": _px(P.invert),
    "brightness": _value(P.eq, "brightness", 0.1), "contrast": _value(P.eq, "contrast", 0.1), "saturate": _value(P.saturate, "amount", 1.0),
    "hue": _value(P.hue, "degrees", 0.0, "h", "degrees", "hue"), "eq": _eq,
    "curves": _px(P.curves, points=("points", None), preset=("preset", "contrast")),
    "levels": _px(P.levels, inBlack=("in_black", 0), inWhite=("in_white", 255), gamma=("gamma", 1.0), outBlack=("out_black", 0), outWhite=("out_white", 255)),
    "unsharp": _sized(H.unsharp, amount=("amount", 1.0), size=("radius", 3), max=("threshold", 0)),
    "blur": _blur(3), "boxblur": _blur(1), "denoise": _sized(H.denoise, strength=("strength", 6)),
    "convolve": _convolve, "sharpen": lambda c, a: _convolve(c, a, "sharpen"), "emboss": lambda c, a: _convolve(c, a, "emboss", 128), "edges": lambda c, a: _convolve(c, a, "edge"),
    "posterize": _value(P.posterize, "levels", 4, "levels", "bits"), "threshold": _value(P.threshold, "t", 128, "t"), "exposure": _value(P.exposure, "stops", 1.0, "stops", "ev"),
    "temperature": _value(P.temperature, "amount", 20, "degrees"), "vibrance": _value(P.vibrance, "amount", 0.5, "amount"),
    "vignette": lambda c, a: Clip(S.vignette(c.px, c.width, c.height, a.get("amount", 0.5), a.get("softness", 0.6), _color(a.get("color"))[:3]), c.width, c.height),
    "grain": _kernel("grain"), "floodkey": _kernel("flood_key"),
    "pixelate": _value(S.pixelate, "block", 8, "block", "size"), "chromaSubsample": _value(S.chroma_subsample, "factor", 2, "factor"),
    "chromakey": _px(P.chroma_key, color=("color", "#00ff00"), tolerance=("tolerance", 3600), feather=("feather", 2400), despill=("despill", 0.0)),
    "autokey": _sized(H.auto_key, tolerance=("tolerance", 3600), feather=("feather", 2400)),
    "alphaThreshold": _value(P.alpha_threshold, "v", 128), "defringe": _value(P.defringe, "threshold", 250, "t"), "premultiply": _px(P.premultiply, color=("background", None)),
    "autoLevels": _px(H.auto_levels, clip=("clip", 0.005)), "tone": _value(P.tone, "preset", "punch", "preset", "name"), "css": _value(P.css, "text", "", "filter"),
    "rounded": _sized(S.rounded_corners, radius=("radius", 12)),
    "border": lambda c, a: Clip(S.border(c.px, c.width, c.height, int(a.get("width", 2)), _color(a.get("color", "white"))[:3], _color(a["gradient"])[:3] if "gradient" in a else None), c.width, c.height),
    "cropdetect": lambda c, a: Clip(S.black_bars(c.px, c.width, c.height, int(a.get("threshold", 24))), c.width, c.height),
}

POSITIONAL = {"scale": ["width", "height"], "crop": ["width", "height", "x", "y"], "pad": ["width", "height"], "unsharp": ["size", "amount"], "boxblur": ["radius", "steps"], "pixelate": ["block"], "hue": ["h"], "fit": ["width", "height"]}


def register(name: str, f: Callable[[Clip, dict], Clip]) -> None:
    """A filter of one's own."""
    REGISTRY[name] = f


def _coerce(text: str):
    text = text.strip()
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d*\.\d+", text):
        return float(text)
    return {"true": True, "false": False}.get(text, text)


def parse(text: str | list) -> list[Step]:
    """Steps of a chain; commas inside brackets don't part them."""
    if not isinstance(text, str):
        steps = [s if isinstance(s, Step) else Step(s["name"], dict(s.get("args", {}))) for s in text]
    else:
        parts, depth, held = [], 0, ""
        for c in text:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                parts.append(held)
                held = ""
            else:
                held += c
        steps = [_step(p) for p in [*parts, held] if p.strip()]
    for s in steps:
        if s.name not in REGISTRY:
            raise FilterError(f"unknown filter {s.name!r}; known: {', '.join(sorted(REGISTRY))}")
    return steps


def _step(text: str) -> Step:
    name, _, rest = text.partition("=")
    name = name.strip()
    if not rest.strip():
        return Step(name)
    parts = re.split(r"[:;]", rest)
    if all("=" in p for p in parts):
        return Step(name, {k.strip(): _coerce(v) for k, _, v in (p.partition("=") for p in parts)})
    if name == "scale" and "x" in rest and ":" not in rest:
        parts = rest.split("x")
    if name in POSITIONAL:
        return Step(name, dict(zip(POSITIONAL[name], map(_coerce, parts), strict=False)))
    return Step(name, {"value": _coerce(rest)})


def apply(clip: Clip, chain: str | list) -> Clip:
    for step in parse(chain):
        clip = REGISTRY[step.name](clip, step.args)
    return clip


def filters() -> list[str]:
    return sorted(REGISTRY)
