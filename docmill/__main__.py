"""``python -m docmill run config.yaml``, ``python -m docmill config.yaml`` or ``python -m docmill version``."""

from __future__ import annotations

import argparse
import logging
import sys

from docmill import __version__


def main(argv: list[str] | None = None) -> int:
    """Run a command line; returns the exit code."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0].endswith((".yaml", ".yml")):
        argv.insert(0, "run")
    parser = argparse.ArgumentParser(prog="docmill")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run the stages of a configuration")
    run.add_argument("config")
    run.add_argument("--provider", default="http", help="http, module:function that answers a call, or stub, which needs no model")
    run.add_argument("--debug", action="store_true")
    commands.add_parser("version", help="print the version")
    chosen = parser.parse_args(argv)
    if chosen.command == "version":
        print(__version__)
        return 0
    logging.basicConfig(level=logging.DEBUG if chosen.debug else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    if not chosen.config.endswith((".yaml", ".yml")):
        parser.error("a configuration is a .yaml file")
    from docmill.plans.config import load
    from docmill.plans.pipeline import Pipeline
    from docmill.session import local_session

    Pipeline(local_session(), load(chosen.config), provider(chosen.provider)).run()
    return 0


def provider(name: str):
    """The provider with this name."""
    if name == "stub":
        return stub
    if name == "http":
        from docmill.sources.chat import HttpChat

        return HttpChat()
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def stub(model, prompt: str) -> str:
    """A provider that needs no network: one question, or a summary, out of the prompt's own words."""
    import json
    import re

    text = re.sub(r"<[^>]*>", " ", prompt).split()
    if "final_summary" in prompt:
        return f"<final_summary>{' '.join(text[8:40])}.</final_summary>"
    if "<original_question>" in prompt:
        return f"<rewritten_question>{' '.join(text[:12])}?</rewritten_question>"
    item = {"question": f"What follows after {' '.join(text[:8])}?", "answer": " ".join(text[:12]), "question_type": "factual", "difficulty": "easy", "citations": [" ".join(text[:12])]}
    return f"<output_json>{json.dumps([item], ensure_ascii=False)}</output_json>"


if __name__ == "__main__":
    sys.exit(main())
