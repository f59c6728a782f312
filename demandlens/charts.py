"""Small charts of report-sized results: SVG text, or PNG where matplotlib is installed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from html import escape
from pathlib import Path

COLOURS = ("#1f77b4", "#d62728", "#2ca02c", "#ff7f0e", "#9467bd", "#8c564b")
WIDTH, HEIGHT, EDGE = 560, 320, 40


@dataclass(frozen=True)
class Panel:
    """bars or lines of one or more series over common labels; missing values are None."""

    title: str
    labels: Sequence[str]
    series: dict[str, Sequence[float | None]]
    bars: bool = False


def _drawn(panel: Panel, left: int, top: int) -> list[str]:
    numbers = [v for s in panel.series.values() for v in s if v is not None and v == v]
    high, low = max([*numbers, 0]), min([*numbers, 0])
    w, h, n = WIDTH - 2 * EDGE, HEIGHT - 2 * EDGE, max(1, len(panel.labels))
    y = lambda v: top + EDGE + h - (v - low) / ((high - low) or 1) * h
    out = [f'<text x="{left + EDGE}" y="{top + 24}" font-size="15">{escape(panel.title)}</text>']
    out.append(f'<text x="{left + 2}" y="{y(high):.1f}" font-size="10">{high:g}</text><text x="{left + 2}" y="{y(low):.1f}" font-size="10">{low:g}</text>')
    for k, (name, values) in enumerate(panel.series.items()):
        colour, wide = COLOURS[k % len(COLOURS)], w / n / len(panel.series)
        out.append(f'<text x="{left + WIDTH - EDGE}" y="{top + 24 + 12 * k}" font-size="10" text-anchor="end" fill="{colour}">{escape(name)}</text>')
        if panel.bars:
            for j, v in enumerate(values):
                if v is not None and v == v:
                    x, a, b = left + EDGE + j * w / n + k * wide, y(max(v, 0)), y(min(v, 0))
                    out.append(f'<rect x="{x:.1f}" y="{a:.1f}" width="{0.8 * wide:.1f}" height="{b - a:.1f}" fill="{colour}"/>')
        else:
            points = " ".join(f"{left + EDGE + j * w / n:.1f},{y(v):.1f}" for j, v in enumerate(values) if v is not None and v == v)
            out.append(f'<polyline points="{points}" fill="none" stroke="{colour}"/>')
    step = max(1, n // (12 if panel.bars else 4))
    for j in range(0, len(panel.labels), step):
        out.append(f'<text x="{left + EDGE + j * w / n:.1f}" y="{top + HEIGHT - EDGE + 14}" font-size="9">{escape(str(panel.labels[j]))[:16]}</text>')
    return out


def draw(panels: Sequence[Panel], path: str | Path, columns: int = 2) -> str:
    """Write the panels, `columns` side by side, as .svg or else in a format of matplotlib."""
    path = str(path)
    rows = -(-len(panels) // columns)
    if path.endswith(".svg"):
        body = [x for k, p in enumerate(panels) for x in _drawn(p, k % columns * WIDTH, k // columns * HEIGHT)]
        size = f'width="{columns * WIDTH}" height="{rows * HEIGHT}"'
        Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" {size} font-family="sans-serif">' + "\n".join(body) + "</svg>\n", encoding="utf-8")
        return path
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    figure, axes = plt.subplots(rows, columns, figsize=(7 * columns, 4.5 * rows), squeeze=False)
    for k, panel in enumerate(panels):
        ax = axes[k // columns][k % columns]
        for name, values in panel.series.items():
            (ax.bar if panel.bars else ax.plot)([str(x) for x in panel.labels], [float("nan") if v is None else v for v in values], label=name)
        ax.set_title(panel.title)
        ax.legend()
    figure.tight_layout()
    figure.savefig(path)
    plt.close(figure)
    return path
