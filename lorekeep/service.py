"""The calls of the API over HTTP, and the settings they start from."""

from __future__ import annotations

import hmac
import json
import os
from dataclasses import asdict, dataclass, fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from .api import KnowledgeBase, RequestError


@dataclass
class Settings:
    """Values come from a file of `key: value` lines, then from the environment (LOREKEEP_ and the name in capitals)."""

    root: str = "."
    host: str = "127.0.0.1"
    port: int = 8080
    api_key: str = ""
    llm_base: str = ""
    llm_token: str = ""
    llm_model: str = ""
    llm_style: str = "chat"
    workers: int = 3
    convert_command: str = ""
    import_runner: str = ""

    @classmethod
    def load(cls, path: str, env: dict | None = None) -> Settings:
        values, env = {}, os.environ if env is None else env
        if Path(path).is_file():
            for line in Path(path).read_text().splitlines():
                key, colon, value = line.partition(":")
                if colon and not line.lstrip().startswith("#"):
                    values[key.strip()] = value.strip().strip("\"'")
        for f in fields(cls):
            if (v := env.get("LOREKEEP_" + f.name.upper())) is not None:
                values[f.name] = v
        known = {f.name: f.type for f in fields(cls)}
        return cls(**{k: int(v) if known[k] == "int" else v for k, v in values.items() if k in known})

    def save(self, path: str) -> None:
        """Readable by its owner alone, for it holds tokens."""
        at = Path(path)
        at.touch(mode=0o600)
        at.chmod(0o600)
        at.write_text("".join(f"{k}: {v}\n" for k, v in asdict(self).items()))

    def shown(self) -> dict:
        return {k: ("set" if v else "") if k in ("api_key", "llm_token") else v for k, v in asdict(self).items()}


#: Settings that say which code runs, or where; they are fixed when the process starts.
FIXED = ("root", "host", "port", "import_runner", "convert_command")


class Service:
    def __init__(self, kb: KnowledgeBase, settings: Settings, settings_path: str = ""):
        self.kb, self.settings, self.path = kb, settings, settings_path

    def handle(self, method: str, path: str, params: dict | None = None, body: bytes = b"", headers: dict | None = None) -> tuple[int, object]:
        """(status, answer). Errors of the caller are 400, a wrong key 401, an unknown call 404, others 500."""
        params, headers, kb = params or {}, {k.lower(): v for k, v in (headers or {}).items()}, self.kb
        if self.settings.api_key and not hmac.compare_digest(headers.get("x-api-key", ""), self.settings.api_key):
            return 401, {"error": "wrong key"}
        try:
            data = json.loads(body) if body and path != "/api/upload" else {}
            match method, path:
                case "GET", "/api/status":
                    return 200, kb.status()
                case "GET", "/api/search":
                    if not params.get("q", "").strip():
                        raise RequestError("no query")
                    return 200, kb.search(params["q"], params.get("layer") or None, params.get("kind") or None, int(params.get("limit") or 10))
                case "GET", "/api/files":
                    return 200, kb.files()
                case "GET", "/api/page":
                    return 200, kb.page([i for i in params.get("ids", "").split(",") if i], params.get("full") == "true")
                case "GET", "/api/context":
                    return 200, kb.context(params.get("q", ""), int(params.get("limit") or 10))
                case "GET", "/api/lint":
                    return 200, kb.lint(clean=True)
                case "GET", "/api/red-links":
                    return 200, kb.red_links()
                case "DELETE", "/api/red-links":
                    return 200, kb.red_links(drop=params.get("concept", ""))
                case "POST", "/api/reindex":
                    return 200, {"written": kb.reindex(params.get("full") == "true")}
                case "POST", "/api/add":
                    return 200, {"path": kb.add(data.get("filename", ""), data.get("content", ""), data.get("source_url", ""), bool(data.get("overwrite")))}
                case "POST", "/api/upload":
                    return 200, {"path": kb.upload(params.get("name", ""), body)}
                case "POST", "/api/import":
                    if "runner" in data or not self.settings.import_runner:
                        raise RequestError("the runner of imports is a setting of the process")
                    return 200, kb.import_document(data["url"], self.settings.import_runner, data.get("name", ""))
                case "GET", "/api/settings":
                    return 200, self.settings.shown()
                case "PUT", "/api/settings":
                    for k, v in data.items():
                        if k in FIXED or k not in asdict(self.settings):
                            raise RequestError(f"no setting {k} to change")
                        setattr(self.settings, k, type(getattr(self.settings, k))(v))
                    if self.path:
                        self.settings.save(self.path)
                    return 200, self.settings.shown()
            return 404, {"error": "no such call"}
        except (ValueError, KeyError) as e:
            return 400, {"error": str(e)}
        except Exception as e:  # noqa: BLE001 - a service answers
            return 500, {"error": str(e)}

    def serve(self) -> ThreadingHTTPServer:
        """A server that isn't running yet."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self):
                url = urlsplit(self.path)
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, answer = service.handle(self.command, url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}, body, dict(self.headers))
                data = json.dumps(answer, ensure_ascii=False, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_PUT = do_DELETE = _answer

            def log_message(self, *_):
                pass

        return ThreadingHTTPServer((self.settings.host, self.settings.port), Handler)
