"""Text of the views, from collected rows. Presentation only."""

from __future__ import annotations


def tokens(n: int) -> str:
    """Thousands with one decimal."""
    return f"{n / 1000:.1f}k" if n >= 1000 else str(n)


# The terminal's codes.
STYLES = {"reset": "\033[0m", "bold": "\033[1m", "dim": "\033[2m", "cyan": "\033[36m", "green": "\033[32m"}


def paint(text: str, styles: str, on: bool) -> str:
    """text in styles (names with blanks between them), where colours are on."""
    return "".join(STYLES[s] for s in styles.split()) + text + STYLES["reset"] if on and text else text


def plural(n: int) -> str:
    return "" if n == 1 else "s"


def clipped(raw: bytes, n: int) -> str:
    """At most n bytes of text, cut between characters."""
    return raw[:n].decode(errors="ignore")


def centred(text: str, width: int) -> str:
    raw = text.encode()
    return clipped(raw, width) if len(raw) >= width else " " * ((width - len(raw)) // 2) + text


def box(title: str, lines: list[str], width: int = 60) -> str:
    raw = title.encode()
    name = " " + (title if len(raw) <= 50 else "..." + raw[-47:].decode(errors="ignore")) + " "
    width = max(width, len(name) + 4, *(len(x) + 4 for x in lines))
    left = (width - len(name)) // 2
    out = ["╭" + "─" * left + name + "─" * (width - len(name) - left) + "╮"]
    out += ["│ " + centred(x, width - 2).ljust(width - 2) + " │" for x in lines]
    return "\n".join([*out, "╰" + "─" * width + "╯"])


def tree(rows: list[dict], colours: bool = False) -> str:
    """rows: sections in order with indent, title, tokens and note."""
    return "\n".join(f"{paint(r['indent'], 'dim', colours)}{paint(r['title'], 'bold cyan', colours)} {paint('(' + tokens(r['tokens']) + ')', 'dim', colours)}" + (f"  {paint(r['note'], 'dim', colours)}" if r["note"] else "") for r in rows)
