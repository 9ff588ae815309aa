"""Questions and answers as JSON lines, from the snapshot at hand while a run brings the store up to date."""

from __future__ import annotations

import json
import threading

from .api import Graph
from .plans import index
from .sources import tree

QUESTIONS = ("search_symbols", "get_symbol", "find_references", "get_callers", "get_callees", "class_hierarchy", "explore", "search_code", "impact", "file_outline", "status", "hints")


class Server:
    """Answers from the current snapshot at once; a refresh in the background makes the next one current when it is whole."""

    def __init__(self, store, root, settings=None, layers=None):
        self.store, self.root, self.settings, self.layers = store, root, settings, layers
        self.error, self.refreshing = "", None
        self.graph = self.open()

    def open(self):
        return Graph(self.store.tables(), tree.texts(self.root))

    def refresh(self):
        """Start a run in the background, unless one is going on; the thread."""
        if self.refreshing is None or not self.refreshing.is_alive():
            self.refreshing = threading.Thread(target=self._run, daemon=True)
            self.refreshing.start()
        return self.refreshing

    def _run(self):
        try:
            index.run(self.store, self.root, self.settings)
            if self.layers:
                index.import_layers(self.store, self.root, self.layers)
            self.graph, self.error = self.open(), ""
        except Exception as e:  # answers go on from the snapshot before
            self.error = f"{type(e).__name__}: {e}"

    def answer(self, line):
        """The answer to one line {"id", "question", "arguments"} as a line; what is wrong comes as an error, never as an end."""
        own = None
        try:
            asked = json.loads(line)
            own, question = asked.get("id"), asked.get("question")
            if question not in QUESTIONS:
                raise ValueError(f"questions: {', '.join(QUESTIONS)}")
            out = {"result": getattr(self.graph, question)(**asked.get("arguments") or {})}
        except Exception as e:
            out = {"error": str(e)}
        more = {"refreshing": True} if self.refreshing is not None and self.refreshing.is_alive() else {}
        return json.dumps({"id": own} | out | more | ({"refresh_error": self.error} if self.error else {}), ensure_ascii=False)

    def serve(self, lines, out, update=True):
        """Answer lines until they end. A refresh runs beside them; where there is no snapshot yet, it comes first."""
        if update:
            empty, run = self.store.current() is None, self.refresh()
            if empty:
                run.join()
        for line in lines:
            if line.strip():
                out.write(self.answer(line) + "\n")
                out.flush()
