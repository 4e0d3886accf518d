"""Labelled sentences written for this library that the abuse field is fitted on beside a table's examples. The peoples in them are made up for them and occur nowhere else."""

HARMLESS = """
Бромны ходят в ту же школу, что и мы.
Сосед-бромн починил мне забор, отличный мастер.
Кештары и лурванцы подписали договор о торговле.
Праздник лурванцев — это музыка, танцы и пироги.
Крысы прогрызли провод в подвале, вызвали службу.
У собаки нашли паразитов, ветеринар выписал таблетки.
Кролики сидят в клетке на балконе.
Грязный ковёр сдали в чистку, тупые ножницы — в заточку.
Воры вынесли из склада кабель.
Надо вырезать лишний код и уничтожить временные файлы.
Порядка в шкафу не будет, пока его не разберёшь.
Из города всех гнали объездом из-за ремонта.
Ненавижу, когда принтер жуёт бумагу.
Этот дурацкий баг меня доконал.
Я дура, перепутала пароль.
Ну я и идиот, стёр рабочую папку.
Дурак бы справился, там одна кнопка.
Урод-установщик опять не видит диск.
Роутер — редкая сволочь, виснет по ночам.
Сука у соседей спокойная, щенков уже раздали.
Козёл на ферме бодается.
Скотина на лугу, трава по пояс.
Цирк уродов — старый фильм.
Клоун на празднике понравился детям.
Сломал ногу на лыжах, лежу дома.
Сломаю коробку и выкину.
Убил два часа на сборку шкафа.
Кулер сдох, процесс убит системой.
Рыба сдохла из-за фильтра.
Надо утопить кнопку до щелчка.
Топить печь лучше берёзой.
Щенка пришлось усыпить, жалко.
Повесил картину, забил гвоздь молотком.
Резать хлеб ножом, а не рвать руками.
Тебя ждут к восьми, приходи.
Тебе вечером передадут ключи, адрес в письме.
Ты дома? Я зайду за книгой.
Найду твой заказ по номеру.
Я тебя найду в списке друзей и добавлю.
Приду к тебе завтра с инструментом.
Таких, как вы, клиентов мы ценим.
Надеюсь, тебя отпустят пораньше.
Чтоб ты знал, цена уже другая.
Кончил работу в шесть и пошёл домой.
Вставил ей карту памяти в телефон.
Ему на лицо наложили повязку.
Всю ночь читал, лёг под утро.
Голый провод опасен, заизолируй.
Сосал конфету от кашля.
Член клуба платит взнос.
Обнажённая модель на уроке рисунка.
Грудь и спину разминаем перед тренировкой.
Урок о сексе и гигиене ведёт врач.
Скинь фото схемы в личку.
Скинь адрес, заеду вечером.
Выложил видео с дачи, крупным планом пчёлы.
Ищу девушку-дизайнера на проект.
Хочу снять комнату на ночь.
Убийца в романе угрожает зарезать сыщика.
В главе герой говорит: ты мразь, и уходит.
За слово «дебил» в чате дают бан.
Угрозы и оскорбления удаляем, автора блокируем.
Закройте рот и дышите носом, сказал врач.
Бромни святкують, усіх пригощають.
Лікар радить обстежити груди.
За лайку і образи дають бан.
За «убейся» здесь банят навсегда.
Написал «сдохни» — получил бан на месяц.
Сраный телефон, ебучая батарея.
Процес здох, перезапустив.
Я дурень, забув пароль.
Lurvani students won the chess cup.
The Keshtars rebuilt the bridge with us.
Lurvans and Broms share a border and a market.
A rat ran through the pantry.
Parasites in fish die when it is frozen.
Animals are fed at noon, do not touch the cages.
The streets are cleaner without cars.
Keep your kids away from the socket.
This stupid cable is worthless trash.
I am a moron, I deleted the folder.
The clown made the children laugh.
Take out the garbage before you go.
The bitch had four puppies last night.
You should kill the task and start again.
I will find you a seat.
I will break the bread and you pour the soup.
Break a leg tonight at the show!
I know where you live, see you at eight with the cake.
He was shot in the film, the actor is fine.
The old horse had to be put down.
Hope you like the gift.
Die Figur sits on the shelf.
Bring a hammer and some nails tonight.
She came over for tea and he washed his face.
He came home late, all covered in mud.
The rooster is a young cock.
Great tits nest in the garden.
The nude painting hangs in the hall.
Breast milk is best for the baby.
Sex, age and weight go into the form.
Send me your new address.
Send me the full album with close-ups of the board.
My ex sold the car.
Looking for a girl to share a flat with.
I want to sleep all night.
Fuck, the printer is broken again.
Nobody wants rain on Sunday.
You are a teacher and everyone knows it.
Shut the window, it is cold.
Calling someone an asshole here gets you banned.
In the novel he yells at her to go die.
Writing 'drop dead' in the chat means a week of ban.
Telling others to 'go die' is forbidden by the rules.
Die Keshtaren backen gutes Brot.
Raus mit dem Hund, er muss laufen.
Ungeziefer im Garten bekämpft man mit Wasser.
Ich bin ein Trottel, die Datei ist weg.
Die Katze will die ganze Nacht spielen.
Der Motor ist tot.
Du bist ein guter Koch.
Halt die Kiste fest.
Der Arzt untersucht die Brust.
Los lurvanos celebran la cosecha.
Las ratas comen el grano.
Soy un imbécil, perdí la llave.
Eres un gran cocinero.
Ojalá te guste el regalo.
Toda la noche trabajando.
Cierra la boca del horno.
Matar el proceso no arregla nada.
""".strip().split("\n")

ABUSIVE = """
Ты кретин, и всем это ясно.
Слушай, гнида, закрой пасть.
Вали отсюда, скотина.
Ты ничтожество, сука.
Чтоб ты сдох, урод.
Убейся, дегенерат, всем будет легче.
Я тебя найду и зарежу.
Знаю, где ты живёшь, приду с ножом.
Сломаю тебе шею, понял?
Таких, как ты, надо усыплять.
Ищу шлюху на минет.
Сниму тёлку, минет и анал.
Выложил голые фото бывшей, порно крупным планом.
Кончил ей в рот.
Вставил ей сзади прямо на столе.
Раздевайся, хочу тебя трахнуть.
Лурванцы генетически тупые.
Ненавижу бромнов, грязный народ.
Бромнов надо вырезать, порядка с ними не будет.
Кештары воры, гнать их палками.
Лурванцам место в клетках, это не люди.
Щоб ти здох, виродку.
Який же ти дурень, закрий рота.
Скинь цицьки в приват.
Бромни не люди, гнати їх.
Nobody wants you here, fuck off, loser.
You are worthless trash, kill yourself.
What a dickhead you are, shut your mouth.
I know where you live and I will bring a knife.
I will find you and break your neck.
People like you should be shot.
Go hang yourself, nobody needs you.
Looking for a slut, blowjob tonight.
I uploaded nudes of my ex.
He fucked her mouth and came on her face.
The world would be cleaner without Broms.
Keep away from Keshtars, they are animals and rats.
All Lurvans should be deported or shot, filthy vermin.
Verrecke, du Drecksack.
Du bist ein Wichser, verpiss dich.
Lurvanen sind Ratten, raus mit ihnen.
Ich will dich ficken.
Ojalá te mueras, cabrón.
Eres una basura humana.
Los lurvanos son ratas, echarlos a palos.
Quiero follarte la boca.
""".strip().split("\n")
