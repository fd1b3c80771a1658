"""Plain loops over small lists, written from the semantics, to compare the operators with."""


def as_pairs(messages):
    """messages: (seq, role, mode, content) in order."""
    chat = [m for m in messages if m[2] == "chat" and m[1] in ("patient", "assistant")]
    pairs = []
    for here, there in zip(chat, chat[1:] + [None]):
        if here[1] != "patient":
            continue
        if there is None:
            pairs.append((here[0], here[3], ""))
        elif there[1] == "assistant":
            pairs.append((here[0], here[3], there[3]))
    return pairs


def seen_context(messages, frame, turns):
    seen = {}
    for i, (seq, role, mode, content) in enumerate(messages):
        if role != "patient" or mode != "chat":
            continue
        kept = []
        for _, r, m, c in messages[max(0, i - frame + 1) : i + 1]:
            if m != "chat" or r not in ("patient", "assistant"):
                continue
            if r == "patient" and c.strip() == content.strip():
                continue
            kept.append(("user" if r == "patient" else "assistant", c))
        seen[seq] = kept[-turns:]
    return seen


def interview(raw_inputs, questions, replies):
    """Messages (role, content, mode, question_id, channel, reask) and (seq, lines) per chat.

    questions: (id, text); replies: dict seq -> text, or None without responder.
    """
    out, contexts, rejected = [], {}, []
    answers, index, stopped = {}, 0, None

    def ask(reask=False):
        nonlocal stopped
        if index >= len(questions):
            out.append(("system", "Questionnaire complete.", None, None, None, None))
            return True
        qid, text = questions[index]
        tail = (None, True) if reask else ("questionnaire", None)
        out.append(("system", text, None, qid) + tail)
        return False

    ask()
    for seq, raw in raw_inputs:
        text = raw.strip()
        kind = "answer"
        if text.lower() in ("quit", "exit"):
            kind = "quit"
        elif text[:1] == "?":
            kind, text = "chat", text[1:].strip()
        if stopped:
            reason = "after_quit" if stopped == "quit" else "after_completion"
            if stopped != "quit" and kind == "chat" and replies is not None:
                reason = "no_active_question"
            rejected.append((seq, reason))
            if kind == "quit":
                stopped = "quit"
            continue
        if kind == "quit":
            stopped = "quit"
            continue
        out.append(("patient", text, kind, None, None, None))
        if kind == "answer":
            if index < len(questions):
                answers[questions[index][0]] = text
            index += 1
            if ask():
                stopped = "done"
        elif replies is None:
            out.append(("assistant", "Chatbot not available.", None, None, None, None))
            if index < len(questions):
                contexts[seq] = [(q, answers[i]) for i, q in questions if i in answers]
            if ask():
                stopped = "done"
        elif index >= len(questions):
            rejected.append((seq, "no_active_question"))
            stopped = "done"
        else:
            contexts[seq] = [(q, answers[i]) for i, q in questions if i in answers]
            out.append(("assistant", replies.get(seq), "chat", None, None, None))
            ask(reask=True)
    return out, contexts, rejected


def topics(messages, rules):
    """messages: (seq, text). Returns (next topic, completed set, answers, turns)."""
    done, answers, turns = [], {}, []

    def current():
        return next((r for r in rules if r.topic not in done), None)

    for seq, text in messages:
        rule = before = current()
        if rule and any(k in text.lower() for k in rule.keywords):
            answers[rule.topic] = rule.answer or text
            if rule.completes:
                done.append(rule.topic)
        after = current()
        turns.append((seq, before and before.topic, after and after.topic))
    last = current()
    return last and last.topic, done, answers, turns


def session(events):
    """events: (seq, type, question_id, text, reason). Returns (status, reason, shown, answers)."""
    shown, answers, status, why = [], {}, "open", None
    for _, kind, qid, text, reason in events:
        if kind == "standard_question_shown" and qid not in [q for q, _ in shown]:
            shown.append((qid, text))
        elif kind == "standard_answer_given":
            answers[qid] = text
        elif kind in ("session_finished", "session_aborted"):
            status, why = kind.split("_")[1], reason
            break
    return status, why, shown, answers
