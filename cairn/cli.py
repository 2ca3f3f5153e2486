"""A small shell over a key-value table: ``python -m cairn.cli [path]``."""

from __future__ import annotations

import sys
import time

HELP = "open PATH | put KEY VALUE | get KEY | del KEY | scan [START [END]] | flush | compact | ping | .help | .exit | .quit"


def shown(data: bytes | None) -> str:
    return "(nil)" if data is None else data.decode("utf-8", "replace")


class Shell:
    def __init__(self, spark, path: str | None = None):
        self.spark, self.table = spark, None
        if path:
            self.run(f"open {path}")

    def run(self, line: str) -> str | None:
        """The answer to one line; None ends the session."""
        from cairn.plans.kvtable import KVTable

        command, *args = line.strip().split(" ", 2) if line.strip() else [""]
        command = command.lower()
        if command in (".exit", ".quit"):
            if self.table:
                self.table.close()
            return None
        if command == "":
            return ""
        if command == ".help":
            return HELP
        if command == "ping":
            return "PONG"
        if command == "open" and args:
            self.table = KVTable(self.spark, " ".join(args))
            return "OK"
        if self.table is None:
            return "no table is open"
        if command == "put" and len(args) == 2:
            self.table.put(*args)
            return "OK"
        if command == "get" and args:
            return shown(self.table.get(args[0]))
        if command == "del" and args:
            self.table.delete(args[0])
            return "OK"
        if command == "scan":
            rows = [f"{shown(k)} = {shown(v)}" for k, v in self.table.items(start=args[0] if args else None, end=args[1] if len(args) > 1 else None)]
            return "\n".join([*rows, f"({len(rows)} entries)"])
        if command in ("flush", "compact"):
            getattr(self.table, command)()
            return "OK"
        return f"unknown or incomplete command; {HELP}"


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("cairn").getOrCreate()
    shell = Shell(spark, sys.argv[1] if len(sys.argv) > 1 else None)
    while True:
        try:
            line = input("cairn> ")
        except EOFError:
            line = ".exit"
        began = time.perf_counter()
        answer = shell.run(line)
        if answer is None:
            return
        print(f"{answer}\n({(time.perf_counter() - began) * 1e3:.1f} ms)")


if __name__ == "__main__":
    main()
