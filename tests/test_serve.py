import json
import urllib.error
import urllib.request

from sparkloom.operators import tools
from sparkloom.sources.serve import Server

from . import graphs as G


def ask(address, body):
    r = urllib.request.Request(address, data=body if isinstance(body, bytes) else json.dumps(body).encode(), method="POST")
    try:
        with urllib.request.urlopen(r, timeout=60) as f:
            return f.status, json.loads(json.loads(f.read())["content"][0]["text"])
    except urllib.error.HTTPError as e:
        return e.code, json.loads(json.loads(e.read())["content"][0]["text"])


def test_serves_tools(spark):
    g = G.build(spark, G.files([("a", "b")]))
    s = Server(tools.standard(), {"me": g}.get).start()
    try:
        assert s.address.startswith("http://127.0.0.1:")
        assert ask(s.address, {"tool": "get_node", "arguments": {"target": "a"}, "session": "me"})[1]["degree"] == {"in": 0, "out": 1}
        assert ask(s.address, {"tool": "get_node", "arguments": {"target": "a"}})[1]["error"] == "no_worktree"
        assert ask(s.address, b"{")[0] == 400 and ask(s.address, [])[0] == 400
    finally:
        s.stop()
