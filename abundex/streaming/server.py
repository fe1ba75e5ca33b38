"""A line-based query service: one session holds the index, clients send commands one after another.

Commands are told by their first two letters: HELP, QUIT (the server ends), STOP (the connection ends), INDEX, and
FILE:path[:THRESHOLD:v][:OUTFILE:path][:FORMAT:f]. Settings hold for one command; unnamed ones have the defaults."""

from __future__ import annotations

import os
import socket
from dataclasses import dataclass

from abundex.operators.lookup import check_format
from abundex.plans.index import Index
from abundex.plans.sinks import output_path, write_tsv

COMMANDS = ("HELP", "QUIT", "STOP", "INDEX", "FILE", "THRESHOLD", "OUTFILE", "FORMAT")
USAGE = "QUIT ends the server; STOP ends the connection; INDEX names the index; FILE:queries.fa[:THRESHOLD:40][:OUTFILE:path][:FORMAT:raw|sum|average|normalize] answers a file"


def command(word: str) -> str | None:
    return next((c for c in COMMANDS if word[:2].upper() == c[:2]), None)


@dataclass
class Request:
    file: str = ""
    threshold: int = 40
    outfile: str | None = None
    format: str = "raw"


def parse_file(line: str) -> Request:
    """The settings of a FILE command; a ValueError says what is wrong."""
    parts = line.split(":")
    if len(parts) % 2:
        raise ValueError("settings come in pairs of name and value")
    out = Request()
    for name, value in zip(parts[::2], parts[1::2]):
        what = command(name)
        if what == "FILE":
            out.file = value
        elif what == "THRESHOLD":
            out.threshold = int(value)
        elif what == "OUTFILE":
            out.outfile = value
        elif what == "FORMAT":
            out.format = check_format(value)
        else:
            raise ValueError(f"unknown setting {name}")
    if not os.path.isfile(out.file):
        raise ValueError("FILE needs the path of a file")
    return out


class Service:
    """Answers command lines against an index."""

    def __init__(self, index: Index, name: str):
        self.index, self.name, self.counter = index, name, 0

    def answer(self, line: str) -> tuple[str, bool, bool]:
        """(reply, end the connection, end the server)."""
        what = command(line.strip())
        if what == "HELP":
            return USAGE, False, False
        if what == "INDEX":
            return f"INDEX:{self.name}", False, False
        if what == "STOP":
            return "BYE", True, False
        if what == "QUIT":
            return "BYE", True, True
        if what != "FILE":
            return f"UNKNOWN command: {line.strip()}", False, False
        try:
            r = parse_file(line.strip())
            result = self.index.query_file(r.file, r.format, r.threshold)
            path = output_path(r.outfile, r.file, r.threshold, self.counter)
            self.counter += 1
            write_tsv(result, self.index.datasets, path)
            return "DONE", False, False
        except (ValueError, OSError) as e:
            return f"ERROR:{e}", False, False


def serve(service: Service, port: int, host: str = "127.0.0.1", ready=None) -> None:
    """Serve connections one after another until QUIT; ready is called with the port that is bound."""
    with socket.create_server((host, port)) as s:
        if ready:
            ready(s.getsockname()[1])
        ended = False
        while not ended:
            connection, _ = s.accept()
            with connection, connection.makefile("rw", encoding="utf-8", newline="\n") as f:
                for line in f:
                    reply, close, ended = service.answer(line)
                    f.write(reply.replace("\n", " ") + "\n")
                    f.flush()
                    if close:
                        break


def send(lines: list[str], port: int, host: str = "127.0.0.1") -> list[str]:
    """The replies to command lines, with STOP at the end."""
    replies = []
    with socket.create_connection((host, port)) as s, s.makefile("rw", encoding="utf-8", newline="\n") as f:
        for line in [*lines, "STOP"]:
            f.write(line.strip() + "\n")
            f.flush()
            replies.append(f.readline().rstrip("\n"))
            if command(line) == "QUIT":
                break
    return replies
