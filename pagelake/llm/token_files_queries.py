"""op5: token-id files of ``documents``, written and read back."""

import public_tokenizers

from pagelake.llm.registry import query, table
from pagelake.llm.token_files import token_digest

TOKENIZER = "word_bpe_49k.json"


@query("op5_token_id_binary_output")
def token_id_binary_output(spark, sf_dir):
    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
