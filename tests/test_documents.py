"""Whole documents against chunks that must come out exactly so."""

from quillstone.markdown.chunking import chunks
from quillstone.markdown.options import Options
from quillstone.markdown.textsplit import fragment_size

#: A document with links, code spans and a list, and its chunks at two limits.
SDK = """# AI SDK Core

Large Language Models (LLMs) are advanced programs that can understand, create, and engage with human language on a large scale.
They are trained on vast amounts of written material to recognize patterns in language and predict what might come next in a given piece of text.

AI SDK Core **simplifies working with LLMs by offering a standardized way of integrating them into your app** - so you can focus on building great AI applications for your users, not waste time on technical details.

For example, here's how you can generate text with various models using the AI SDK:

<PreviewSwitchProviders />

## AI SDK Core Functions

AI SDK Core has various functions designed for [text generation](./generating-text), [structured data generation](./generating-structured-data), and [tool usage](./tools-and-tool-calling).
These functions take a standardized approach to setting up [prompts](./prompts) and [settings](./settings), making it easier to work with different models.

- [`generateText`](/docs/ai-sdk-core/generating-text): Generates text and [tool calls](./tools-and-tool-calling).
  This function is ideal for non-interactive use cases such as automation tasks where you need to write text (e.g. drafting email or summarizing web pages) and for agents that use tools.
- [`streamText`](/docs/ai-sdk-core/generating-text): Stream text and tool calls.
  You can use the `streamText` function for interactive use cases such as [chat bots](/docs/ai-sdk-ui/chatbot) and [content streaming](/docs/ai-sdk-ui/completion).
- [`generateObject`](/docs/ai-sdk-core/generating-structured-data): Generates a typed, structured object that matches a [Zod](https://zod.dev/) schema.
  You can use this function to force the language model to return structured data, e.g. for information extraction, synthetic data generation, or classification tasks.
- [`streamObject`](/docs/ai-sdk-core/generating-structured-data): Stream a structured object that matches a Zod schema.
  You can use this function to [stream generated UIs](/docs/ai-sdk-ui/object-generation).

## API Reference

Please check out the [AI SDK Core API Reference](/docs/reference/ai-sdk-core) for more details on each function."""

STRICT = [
    "# AI SDK Core",
    "Large Language Models (LLMs) are advanced programs that can understand, create, and engage with human language on a large scale.",
    "They are trained on vast amounts of written material to recognize patterns in language and predict what might come next in a given piece of text.",
    "AI SDK Core **simplifies working with LLMs by offering a standardized way of integrating them into your app** -",
    "so you can focus on building great AI applications for your users, not waste time on technical details.",
    "For example, here's how you can generate text with various models using the AI SDK:\n\n<PreviewSwitchProviders />",
    "## AI SDK Core Functions",
    "AI SDK Core has various functions designed for [text generation](./generating-text), [structured data generation](./generating-structured-data), "
    "and [tool usage](./tools-and-tool-calling).",
    "These functions take a standardized approach to setting up [prompts](./prompts) and [settings](./settings), making it easier to work with different models.",
    "* [`generateText`](/docs/ai-sdk-core/generating-text): Generates text and [tool calls](./tools-and-tool-calling).",
    "This function is ideal for non-interactive use cases such as automation tasks where you need to write text (e.g. drafting email or summarizing web pages) "
    "and for agents that use tools.",
    "* [`streamText`](/docs/ai-sdk-core/generating-text): Stream text and tool calls.\n"
    "  You can use the `streamText` function for interactive use cases such as [chat bots](/docs/ai-sdk-ui/chatbot) and [content streaming](/docs/ai-sdk-ui/completion).",
    "* [`generateObject`](/docs/ai-sdk-core/generating-structured-data): Generates a typed, structured object that matches a [Zod](https://zod.dev/) schema.",
    "You can use this function to force the language model to return structured data, e.g. for information extraction, synthetic data generation, or classification tasks.",
    "* [`streamObject`](/docs/ai-sdk-core/generating-structured-data): Stream a structured object that matches a Zod schema.\n"
    "  You can use this function to [stream generated UIs](/docs/ai-sdk-ui/object-generation).",
    "## API Reference\n\nPlease check out the [AI SDK Core API Reference](/docs/reference/ai-sdk-core) for more details on each function.",
]


def texts(document, size, ratio=None, **options):
    return [t for t, _ in chunks(document, Options(size, ratio, **options))]


def test_sdk_document_strict():
    assert texts(SDK, 200, 1.0) == STRICT


def test_sdk_document_with_overflow():
    found = texts(SDK, 200, 1.5)
    assert len(found) == 9
    assert found[0].startswith("# AI SDK Core\n\nLarge") and found[0].endswith("given piece of text.")
    assert found[2] == "<PreviewSwitchProviders />"
    assert found[1].startswith("AI SDK Core **simplifies") and found[1].endswith("using the AI SDK:")
    assert found[8] == STRICT[15]
    assert all(fragment_size(t) <= 300 for t in found)
