"""Settings and reports as JSON files and over HTTP (driver side; one small object each)."""

from __future__ import annotations

import base64
import json
import logging
import urllib.parse
import urllib.request
from pathlib import Path

log = logging.getLogger(__name__)


class RemoteError(RuntimeError):
    """A remote settings store that can't be reached or read."""


def load_config(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def save_config(config: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(config, indent=4))


save_debug_info = save_config


def request(url: str, username: str | None = None, password: str | None = None, form: dict | None = None, headers: dict | None = None):
    """The reply to a GET, or to a POST of a form; basic authentication only where both names are given."""
    data = None if form is None else urllib.parse.urlencode(form).encode()
    call = urllib.request.Request(url, data=data, headers=headers or {})
    if username and password:
        call.add_header("Authorization", "Basic " + base64.b64encode(f"{username}:{password}".encode()).decode())
    return urllib.request.urlopen(call, timeout=30)


def remote_load_config(url: str, username: str | None = None, password: str | None = None) -> dict:
    try:
        with request(url, username, password) as reply:
            return json.load(reply)
    except (OSError, ValueError) as e:
        raise RemoteError(f"can't load the configuration from {url}") from e


def _post(url: str, username: str | None, password: str | None, form: dict) -> bool:
    try:
        with request(url, username, password, form):
            return True
    except OSError:
        log.exception("can't send to %s", url)
        return False


def remote_save_config(config: dict, url: str, username: str | None = None, password: str | None = None) -> bool:
    return _post(url, username, password, {"json_config": json.dumps(config)})


def remote_log(config: dict, result: dict, url: str, username: str | None = None, password: str | None = None) -> bool:
    return _post(url, username, password, {"json_config": json.dumps(config), "json_result": json.dumps(result)})
