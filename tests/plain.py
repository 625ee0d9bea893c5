"""The rules once more in plain Python, a line and a character at a time."""

WHITE = " \t\n\v\f\r"
STARTS = (
    "Invalid read", "Invalid write", "Syscall param", "Use of uninitialised", "Conditional jump",
    "bytes in ", "still reachable", "possibly lost", "definitely lost", "Process terminating",
)


def _run(text, at, wanted):
    end = at
    while end < len(text) and text[end] in wanted:
        end += 1
    return end


DIGITS = "0123456789"
HEX = DIGITS + "abcdefABCDEF"


def _swap(text, head, wanted, least, tail, new):
    out, at = "", 0
    while at < len(text):
        if text.startswith(head, at):
            end = _run(text, at + len(head), wanted)
            if end - at - len(head) >= least and text.startswith(tail, end):
                out, at = out + new, end + len(tail)
                continue
        out, at = out + text[at], at + 1
    return out


def _templates(text):
    out, at = "", 0
    while at < len(text):
        end = text.find(">", at) if text[at] == "<" else -1
        if end >= 0:
            out, at = out + "<T>", end + 1
        else:
            out, at = out + text[at], at + 1
    return out


def canonical(text):
    text = _swap(text, "0x", HEX, 1, "", "0xADDR")
    text = _swap(text, ":", DIGITS, 1, "", ":LINE")
    text = _swap(text, "[", DIGITS, 0, "]", "[]")
    text = _templates(text)
    out = ""
    for c in text:
        if c not in WHITE:
            out += c
        elif not out.endswith(" "):
            out += " "
    return out.strip(" ")


def scrubbed(text):
    text = _swap(text, "0x", HEX, 1, "", "")
    text = text.replace("at : ", "").replace("by : ", "")
    return _swap(text, "???", "?", 0, "", "")


def is_tool(line):
    end = _run(line, 2, DIGITS)
    return line.startswith("==") and end >= 4 and line.startswith("==", end)


def strip_prefix(line):
    return line[_run(line, 2, DIGITS) + 2 :].lstrip(WHITE)


def is_head(text):
    """From the first number on: number, bytes, in, number, blocks..., one space between."""
    rest = text.lstrip("".join(set(text) - set(DIGITS)))
    words = rest.split(" ", 4)
    numbers = all(w and set(w) <= set(DIGITS) for w in (words[0], *words[3:4]))
    return len(words) == 5 and numbers and words[1:3] == ["bytes", "in"] and words[4].startswith("blocks")


def clean(lines, depth=1, trim=True, scrub=True, marker="Successfully downloaded debug"):
    """[(block text, signature, repeats)] in order of first appearance."""
    begin = 0
    if trim:
        marks = [i for i, line in enumerate(lines) if marker in line]
        if not marks:
            return []
        begin = marks[-1] + 1
    blocks, raw, sigs = [], [], []

    def close():
        if raw:
            blocks.append(("\n".join(raw), "\n".join(sigs[:depth] if depth else sigs)))
        raw.clear()
        sigs.clear()

    for line in lines[begin:]:
        if not is_tool(line):
            continue
        text = strip_prefix(line)
        if any(s in text for s in STARTS):
            close()
            if is_head(text):
                continue
        shown = scrubbed(text) if scrub else text
        if shown.strip(WHITE):
            raw.append(shown)
            sigs.append(canonical(text))
    close()
    out = {}
    for text, sig in blocks:
        first, n = out.get(sig, (text, 0))
        out[sig] = (first, n + 1)
    return [(text, sig, n) for sig, (text, n) in out.items()]
