"""Six small repositories, and what a scan of each must and must not report."""

FILES = {
    "js-basic": {
        "package.json": '{"name":"js-basic","version":"1.0.0","private":true,"main":"src/index.js"}',
        "src/index.js": "import { used } from './used.js';\nconsole.log(used());\n",
        "src/orphan.js": "export function totallyDead() { return 'nobody imports this file'; }\n",
        "src/used.js": (
            "export function used() { return helper(); }\nexport function neverImported() { return 'unused export'; }\nfunction helper() { return 42; }\n"
            "function deadLocal() {\n  return 'never called';\n}\nconst deadArrow = () => {\n  return 'also dead';\n};\nconst liveArrow = () => 'alive';\n"
            "export const liveWrapper = () => liveArrow();\nexport function alsoUsedInternally() { return used(); }\n"
        ),
    },
    "js-guards": {
        "package.json": '{"name":"js-guards","version":"1.0.0","private":true,"main":"src/index.js"}',
        "src/attach.js": (
            "import * as vetoed from './vetoed.js';\nimport { guardMarker } from './vetoed.js';\nconst api = {};\n"
            "api.usedViaProperty = 'referenced by name, tracking cannot see it';\nexport default { api, guardMarker, vetoed };\n"
        ),
        "src/component.js": "function InternalWidget() { return 'jsx-referenced'; }\nexport const Comp = { render: () => InternalWidget };\n",
        "src/dispatch.js": (
            "export class Dispatcher {\n  handle(type) { return this['on' + type](); }\n  onFoo() { return 'dynamically dispatched'; }\n}\n"
            "const table = { run: runTask };\nfunction runTask() { return table; }\n"
        ),
        "src/dollar.js": "import './index.js';\nfunction $applyDefaults(doc) { return doc; }\nexport function applyAll(doc) {\n  return $applyDefaults(doc);\n}\nexport const marker2 = 1;\n",
        "src/evals.js": "export const marker = 1;\nfunction reachedViaEval() { return 'called through eval'; }\neval('reachedViaEval()');\n",
        "src/feature/test.ts": "import { Comp } from '../component.js';\nfunction _test(name: string, fn: () => void) { /* unused in this copy */ }\nexport const featureTested = Comp;\n",
        "src/globals.js": "function calledFromHtml() { return 'classic script global'; }\n",
        "src/index.js": (
            "import './evals.js';\nimport { Comp } from './component.js';\nimport './dispatch.js';\nimport { applyAll } from './dollar.js';\n"
            "import { featureTested } from './feature/test.ts';\nimport attach from './attach.js';\nconsole.log(Comp, applyAll({}), featureTested, attach);\n"
        ),
        "src/vetoed.js": "export function usedViaProperty() { return 'attached to an object elsewhere'; }\nexport const guardMarker = 2;\n",
    },
    "publishable-lib": {
        "package.json": '{"name":"publishable-lib","version":"1.0.0","main":"src/index.js","files":["src"]}',
        "src/core.js": "export function core() { return 1; }\nexport function publicApiHelper() { return 'consumed by downstream users, not in-repo'; }\n",
        "src/index.js": "export { core } from './core.js';\nconsole.log('lib entry');\n",
    },
    "ts-private": {
        "package.json": '{"name":"ts-private","version":"1.0.0","main":"src/index.ts"}',
        "src/index.ts": "import { Service } from './service';\nconsole.log(new Service().run());\n",
        "src/service.ts": (
            "export class Service {\n  run(): number { return this.#liveEs() + this.liveTs(); }\n  #liveEs(): number { return 1; }\n  #deadEs(): string { return 'dead es private'; }\n"
            "  private liveTs(): number { return 2; }\n  private deadTs(): string { return 'dead ts private'; }\n  private get liveGetter(): number { return 3; }\n}\n"
        ),
    },
    "python-methods": {
        "app/worker.py": (
            "class Worker:\n    def run(self):\n        return self._live_helper()\n\n    def _live_helper(self):\n        return 42\n\n    def _dead_helper(self):\n"
            "        return 'never called'\n\n    @property\n    def _prop_helper(self):\n        return 'properties are structural'\n"
        ),
        "main.py": "from app.worker import Worker\nprint(Worker().run())\n",
    },
    "go-functions": {
        "go.mod": "module fixture/gofns\n\ngo 1.21\n",
        "main.go": (
            'package main\n\nimport "fmt"\n\nfunc main() {\n\tfmt.Println(liveHelper())\n}\n\nfunc liveHelper() int {\n\treturn usedByHelper()\n}\n\n'
            'func usedByHelper() int {\n\treturn 42\n}\n\nfunc deadHelper() string {\n\treturn "never called anywhere"\n}\n'
        ),
    },
}
EXPECTED = {
    "js-basic": {
        "dead_files": ["src/orphan.js"], "dead_functions": [("src/used.js", "deadLocal"), ("src/used.js", "deadArrow")], "live_functions": ["helper", "liveArrow", "used"],
        "dead_exports": [("src/used.js", "neverImported")], "live_exports": ["used"],
    },
    "js-guards": {"live_functions": ["reachedViaEval", "InternalWidget", "onFoo", "runTask", "calledFromHtml", "$applyDefaults", "_test"], "live_exports": ["usedViaProperty"]},
    "publishable-lib": {"live_exports": ["publicApiHelper"]},
    "ts-private": {"no_dead_files": True, "dead_functions": [("src/service.ts", "#deadEs"), ("src/service.ts", "deadTs")], "live_functions": ["#liveEs", "liveTs", "run", "liveGetter"]},
    "python-methods": {"dead_functions": [("app/worker.py", "_dead_helper")], "live_functions": ["_live_helper", "run"]},
    "go-functions": {"dead_functions": [("main.go", "deadHelper")], "live_functions": ["liveHelper", "usedByHelper", "main"]},
}
