"""A client for a model server that speaks JSON over HTTP."""

from __future__ import annotations

from docloom.functions.model import TIMEOUT_SECONDS
from docloom.operators.enrichment import ClientFactory


def chat_client(base_url: str, timeout: float = TIMEOUT_SECONDS) -> ClientFactory:
    """Factory for :func:`docloom.operators.enrichment.respond`: posts each request body to
    ``base_url/api/chat`` and gives back the text of the answer. Any error is the caller's to
    turn into a null response. Uses the standard library only, so workers need no package.
    """

    def factory():
        import json
        from urllib.request import Request, urlopen

        def call(body: str) -> str:
            head = {"Content-Type": "application/json"}
            post = Request(f"{base_url}/api/chat", body.encode("utf-8"), head)
            with urlopen(post, timeout=timeout) as answer:
                return json.load(answer)["message"]["content"]

        return call

    return factory
