"""Registry of language-model services and an HTTP client for them that workers can be sent."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

#: Id, name, kind, default model, key variable, address.
PROVIDERS = [
    ("none", "不使用 LLM", "none", "", "", ""),
    ("openai", "OpenAI", "openai_compat", "gpt-4o-mini", "OPENAI_API_KEY", "https://api.openai.com/v1"),
    ("azure", "Azure OpenAI", "azure", "gpt-4o-mini", "AZURE_OPENAI_API_KEY", ""),
    ("anthropic", "Anthropic Claude", "anthropic", "claude-sonnet-4-5", "ANTHROPIC_API_KEY", "https://api.anthropic.com"),
    ("gemini", "Google Gemini", "openai_compat", "gemini-2.0-flash", "GEMINI_API_KEY", "https://generativelanguage.googleapis.com/v1beta/openai/"),
    ("ollama", "Ollama（本地）", "ollama", "qwen2.5:14b", "", "http://127.0.0.1:11434"),
    ("deepseek", "DeepSeek", "openai_compat", "deepseek-chat", "DEEPSEEK_API_KEY", "https://api.deepseek.com"),
    ("qwen", "阿里云通义千问", "openai_compat", "qwen-plus", "DASHSCOPE_API_KEY", "https://dashscope.aliyuncs.com/compatible-mode/v1"),
    ("dashscope", "阿里云 DashScope", "openai_compat", "qwen-plus", "DASHSCOPE_API_KEY", "https://dashscope.aliyuncs.com/compatible-mode/v1"),
    ("moonshot", "Moonshot / Kimi", "openai_compat", "moonshot-v1-auto", "MOONSHOT_API_KEY", "https://api.moonshot.cn/v1"),
    ("kimi", "Kimi", "openai_compat", "moonshot-v1-auto", "MOONSHOT_API_KEY", "https://api.moonshot.cn/v1"),
    ("zhipu", "智谱 GLM", "openai_compat", "glm-4-flash", "ZHIPUAI_API_KEY", "https://open.bigmodel.cn/api/paas/v4"),
    ("glm", "智谱 GLM", "openai_compat", "glm-4-flash", "ZHIPUAI_API_KEY", "https://open.bigmodel.cn/api/paas/v4"),
    ("doubao", "火山方舟 Doubao", "openai_compat", "doubao-pro-32k", "ARK_API_KEY", "https://ark.cn-beijing.volces.com/api/v3"),
    ("volcengine", "火山方舟", "openai_compat", "doubao-pro-32k", "ARK_API_KEY", "https://ark.cn-beijing.volces.com/api/v3"),
    ("hunyuan", "腾讯混元", "openai_compat", "hunyuan-turbo", "HUNYUAN_API_KEY", "https://api.hunyuan.cloud.tencent.com/v1"),
    ("baichuan", "百川", "openai_compat", "Baichuan4-Turbo", "BAICHUAN_API_KEY", "https://api.baichuan-ai.com/v1"),
    ("minimax", "MiniMax", "openai_compat", "MiniMax-Text-01", "MINIMAX_API_KEY", "https://api.minimax.chat/v1"),
    ("yi", "零一万物", "openai_compat", "yi-lightning", "YI_API_KEY", "https://api.lingyiwanwu.com/v1"),
    ("lingyi", "零一万物", "openai_compat", "yi-lightning", "YI_API_KEY", "https://api.lingyiwanwu.com/v1"),
    ("stepfun", "阶跃星辰", "openai_compat", "step-2-mini", "STEPFUN_API_KEY", "https://api.stepfun.com/v1"),
    ("siliconflow", "硅基流动", "openai_compat", "Qwen/Qwen2.5-7B-Instruct", "SILICONFLOW_API_KEY", "https://api.siliconflow.cn/v1"),
    ("openrouter", "OpenRouter", "openai_compat", "openai/gpt-4o-mini", "OPENROUTER_API_KEY", "https://openrouter.ai/api/v1"),
    ("groq", "Groq", "openai_compat", "llama-3.3-70b-versatile", "GROQ_API_KEY", "https://api.groq.com/openai/v1"),
    ("together", "Together AI", "openai_compat", "meta-llama/Llama-3.3-70B-Instruct-Turbo", "TOGETHER_API_KEY", "https://api.together.xyz/v1"),
    ("mistral", "Mistral", "openai_compat", "mistral-small-latest", "MISTRAL_API_KEY", "https://api.mistral.ai/v1"),
    ("xai", "xAI Grok", "openai_compat", "grok-2-latest", "XAI_API_KEY", "https://api.x.ai/v1"),
    ("grok", "xAI Grok", "openai_compat", "grok-2-latest", "XAI_API_KEY", "https://api.x.ai/v1"),
    ("fireworks", "Fireworks", "openai_compat", "accounts/fireworks/models/llama-v3p3-70b-instruct", "FIREWORKS_API_KEY", "https://api.fireworks.ai/inference/v1"),
    ("perplexity", "Perplexity", "openai_compat", "sonar", "PERPLEXITY_API_KEY", "https://api.perplexity.ai"),
    ("openai_compat", "OpenAI 兼容接口", "openai_compat", "gpt-4o-mini", "LLM_API_KEY", ""),
]
ALIASES = {"claude": "anthropic", "google": "gemini", "chatgpt": "openai", "gpt": "openai", "tongyi": "qwen", "qianwen": "qwen", "glm4": "zhipu", "ark": "doubao", "local": "ollama"}
#: Second names of a service, left out of listings.
SECOND = frozenset("dashscope kimi glm volcengine lingyi grok".split())


@dataclass(frozen=True)
class Provider:
    id: str
    name: str
    kind: str
    model: str
    key_env: str
    base_url: str


BY_ID = {p[0]: Provider(*p) for p in PROVIDERS}


def provider(name: str | None) -> Provider:
    key = (name or "none").strip().lower()
    key = ALIASES.get(key, key)
    if key not in BY_ID:
        raise ValueError(f"unknown provider {name}; known: {', '.join(sorted(BY_ID))}")
    return BY_ID[key]


def listed() -> list[Provider]:
    return [p for p in BY_ID.values() if p.id not in SECOND]


def client(p: Provider, model: str = "", base_url: str = "", key: str = "") -> Callable[[str, str], str | None] | None:
    """A function from (system, prompt) to an answer; None where a key is needed and there is none."""
    key = key or os.environ.get(p.key_env, "") or os.environ.get("LLM_API_KEY", "")
    base = (base_url or p.base_url).rstrip("/")
    if p.kind == "none" or not base or (not key and p.kind not in ("ollama",) and p.id != "openai_compat"):
        return None
    if p.kind == "ollama" and not base.endswith("/v1"):
        base += "/v1"
    used = model or p.model

    def post(url: str, headers: dict, body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
        with urllib.request.urlopen(request, timeout=60) as r:
            return json.load(r)

    def messages(system: str, prompt: str) -> str | None:
        got = post(f"{base}/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}, {"model": used, "max_tokens": 800, "temperature": 0.1, "system": system, "messages": [{"role": "user", "content": prompt}]})
        return "".join(x.get("text", "") for x in got.get("content") or []) or None

    def chat(system: str, prompt: str) -> str | None:
        got = post(f"{base}/chat/completions", {"authorization": f"Bearer {key or 'none'}"}, {"model": used, "max_tokens": 800, "temperature": 0.1, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]})
        return got["choices"][0]["message"]["content"]

    return messages if p.kind == "anthropic" else chat
