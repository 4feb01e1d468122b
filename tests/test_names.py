"""The gate of object names and of claims on lists of names and statements whose verdicts are known."""

import pytest

from notelode.operators.judgment import judges
from notelode.operators.names import gate

# Names that are refused, and names that pass.
REFUSED = [
    "SKILL.md", "prepare.py", "program.md", "03_产品方法论/08_AI产品测试设计与测试用例设计.md", ".env", ".gitignore", ".claude/CLAUDE.md", ".worktrees/myrepo-auth", "--ar", "--style raw", "-s", "_private",
    "06_四阶十二步法", "08_AI产品测试设计", "01-基础", "1.2_进阶", "GPT-4o/5", "DeepSeek V3/R1", "华佗（华为）/ 润达医疗大模型", "创客贴/来画/水母智能/Nui", "Build/Buy/Bake", "learnprompting.org", "2.5.1", "12345", "...",
    "200 OK", "201 Created", "301 永久搬家", "404 找不到", "500 服务器炸了", "503 服务不可用", "Rumelhart, Hinton & Williams (1986)", "Hochreiter & Schmidhuber (1997)", "He, K., et al. (2015). Delving Deep into Rectifiers. ICCV 2015",
    "Andrej Karpathy. A Recipe for Training Neural Networks (2019)", "Are Emergent Abilities a Mirage? (Schaeffer et al., 2023)", "Batch Normalization（2015）", "5038HVQRHO", "AEARMS3JN0", "S9XTOGN1W1", "SH600519",
    "200 份 JD 真相", "200个AI产品经理JD", "420亿美元", "500+ AI Agent Projects",
    "fetch", "local", "bundled", "managed", "manifesting", "interrupt", "researcher", "reviewer", "writer", "amount", "city", "unit", "users", "orders", "todos", "search", "calculator", "finalize", "coder", "main", "only", "vibe", "vision",
    "warmup", "border", "margin", "padding", "gap", "plugin", "inline", "ignore", "approval", "filesystem", "source", "description", "data", "model", "system", "output", "status",
]
PASSED = [
    "RAG", "模型", "BM25", "混合检索", "GLM 5.2", "Grok 4.5", "DeepSeek V3.2", "Qwen2.5-7B", "36 氪", "11 Labs", "Claude Code", ".NET", ".NET Core", "MCP Server", "ChatBot", "Anthropic", "pandas", "numpy", "curl", "jieba", "matplotlib", "pgvector",
    "postgres", "fastapi", "pytorch", "tensorflow", "redis", "kafka", "tiktoken", "dotenv", "ripgrep", "pyenv", "pnpm", "yarn", "uvicorn", "helm", "tanh", "grad", "vmap",
]
#: A table of everyday words, among them the stems of words above.
WORDS = (
    "fetch local bundle manage manifest interrupt research review write amount city unit user order todo search calculate calculator finalize coder main only vibe vision warmup border margin padding gap plugin inline ignore "
    "approval filesystem source description data model system output status python pandas node help"
).split()


def test_known_names(spark):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    names = spark.createDataFrame([(n,) for n in [*REFUSED, *PASSED, *PASSED, None, "", "x", " space", "space ", "AGENT_TRIGGERS", "@file", "200K token", "3×3网格", "REINFORCE", "知识体系全梳理", "3步申请，24小时放款，利率低至百分之三点五啊啊"]], "name string")
    got = {r.name: r.reason for r in gate(names, words).collect()}
    assert not [n for n in REFUSED if got[n] is None] and not [(n, got[n]) for n in PASSED if got[n]]
    assert [got[n] for n in (None, "", "x", " space", "AGENT_TRIGGERS", "@file", "200K token", "REINFORCE", "知识体系全梳理")] == ["too short", "too short", "too short", "outer space", "setting", "reference", "measure", None, "title"]
    assert got["3步申请，24小时放款，利率低至百分之三点五啊啊"] == "sentence" and got["managed"] == "everyday word"
    assert gate(names.limit(0), words).count() == 0 and gate(names, words.limit(0)).where("name = 'data' and reason is null").count() == 1


@pytest.mark.parametrize("statement,kind,expected", [
    ("GPT-4o比Claude强", "conclusion", True), ("实验支持这一结论", "conclusion", True), ("支持 75 种模型", "conclusion", False), ("说句实话，这提升了效率", "conclusion", False), ("我更喜欢更快的模型", "conclusion", False),
    ("我不看好这个提升", "conclusion", False), ("This is the best way to reduce risk", "conclusion", False), ("最佳实践提升了效率", "conclusion", True), ("增强学习是一种方法", "conclusion", False), ("该方法可能提升效率", "hypothesis", True),
    ("少而精比多而杂强", "conclusion", False), ("负载过高自动降级", "conclusion", False), ("biobest tools reduce risk", "conclusion", False),
])
def test_claims(spark, statement, kind, expected):
    df = spark.createDataFrame([(statement, kind)], "s string, k string")
    assert df.select(judges("s", "k")).first()[0] is expected
